"""Guarded regression: a linear baseline and boosted trees on one split.

Trees see a row only through the bins of its features, so training rows that share all bins are one weighted row (a cell) with
their mean target.  Squared loss splits cells as it splits their rows, and the bins are those that Spark draws from the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from tablewright import types as t
from tablewright.functions.draws import draw
from tablewright.ml import evaluate, prepare
from tablewright.session import materialise

# The parameters that may move, as (lowest, highest, default).
PARAMETERS = {
    "n_estimators": (50, 2000, 400),
    "learning_rate": (0.005, 0.5, 0.05),
    "holdout": (0.1, 0.4, 0.2),
    "seed": (0, 2**31 - 1, 42),
}
STEPS = 1_000_000


class LeakageError(ValueError):
    """The target, or nothing at all, was offered as the feature set."""


def checked_parameters(given: Mapping[str, float] | None) -> dict[str, float]:
    given = dict(given or {})
    unknown = sorted(set(given) - set(PARAMETERS))
    if unknown:
        raise ValueError(f"Unknown parameters: {unknown}")
    out = {}
    for name, (low, high, default) in PARAMETERS.items():
        out[name] = given.get(name, default)
        if not low <= out[name] <= high:
            raise ValueError(f"Parameter '{name}' must be between {low} and {high} (got {out[name]}).")
    return out


def in_holdout(row_key: Sequence[str], share: float, seed: int) -> Column:
    """A fixed share of rows by a draw on their key: the same rows after any reshuffle, and in any engine."""
    return draw(row_key, int(seed)) % STEPS < int(round(share * STEPS))


def split_points(booster: GBTRegressor, rows: DataFrame) -> list[list[float]]:
    """Per feature the thresholds between bins that ``booster`` draws from ``rows`` when it fits them."""
    booster._transfer_params_to_java()
    java, jvm = booster._java_obj, rows.sparkSession._jvm
    impl, tree = jvm.org.apache.spark.ml.tree.impl, jvm.org.apache.spark.mllib.tree.configuration
    util, forest = jvm.org.apache.spark.ml.util, getattr(getattr(impl, "RandomForest$"), "MODULE$")
    instances = getattr(getattr(util, "DatasetUtils$"), "MODULE$").extractInstances(java, rows._jdf, jvm.scala.Option.empty())
    categorical = util.MetadataUtils.getCategoricalFeatures(rows._jdf.schema().apply(booster.getFeaturesCol()))
    strategy = java.getOldBoostingStrategy(categorical, tree.Algo.Regression()).treeStrategy()
    metadata = impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, booster.getFeatureSubsetStrategy())
    return [[split.threshold() for split in feature] for feature in forest.findSplits(instances, metadata, booster.getSeed())]


def bin_number(c: Column, thresholds: Sequence[float]) -> Column:
    """How many of the rising ``thresholds`` lie below ``c``."""
    place = InternalFunction.array_binary_search(F.lit(list(thresholds)).cast("array<double>"), c)
    return F.when(place < 0, -place - 1).otherwise(place)  # not found: where it would stand


@dataclass(frozen=True)
class Boosted:
    """Trees over cells: per column the thresholds between bins, and each bin's place among those that training rows fill."""

    model: GBTRegressionModel
    columns: tuple[str, ...]
    thresholds: tuple[tuple[float, ...], ...]
    steps: tuple[tuple[int, ...], ...]

    def predicted(self, df: DataFrame, name: str) -> DataFrame:
        bins = [bin_number(t.column(c), points) for c, points in zip(self.columns, self.thresholds, strict=True)]
        return self.model.setFeaturesCol("_cell").setPredictionCol(name).transform(df.withColumn("_cell", _cell_vector(bins, self.steps))).drop("_cell")


def _cell_vector(bins: Sequence[Column], steps: Sequence[Sequence[int]]) -> Column:
    return array_to_vector(F.array(*[F.get(F.lit([float(x) for x in s]), b) for b, s in zip(bins, steps, strict=True)]))


def _steps(filled: Sequence[int], bins: int) -> tuple[int, ...]:
    """Bins without a training row go with the next bin that has one: no split between the two is ever chosen over the one before both."""
    return tuple(min(sum(f < b for f in filled), len(filled) - 1) + 1 for b in range(bins))


def boost(booster: GBTRegressor, learn: DataFrame, columns: Sequence[str]) -> Boosted:
    """``booster`` fitted on the ``columns`` of ``learn`` by way of its cells; the column ``features`` holds the same numbers."""
    thresholds = split_points(booster, learn)
    named = [f"b{i}" for i in range(len(columns))]
    bins = [bin_number(t.column(c), points).cast("smallint").alias(n) for c, points, n in zip(columns, thresholds, named, strict=True)]
    binned = learn.select(*bins, "actual")
    cells = materialise(binned.groupBy(*named).agg(F.count("*").cast("double").alias("n"), F.avg("actual").alias("actual")), "cells")
    seen = cells.agg(F.count("*").alias("cells"), *[F.collect_set(n).alias(n) for n in named]).first()  # bins, a few per feature
    steps = [_steps(sorted(seen[n]), len(points) + 1) for n, points in zip(named, thresholds)]
    fitted = booster.copy({booster.featuresCol: "_cell", booster.weightCol: "n"})
    # with so many bins every cell is looked at for splits, and there is one between any two steps
    fitted = fitted.setMaxBins(max(booster.getMaxBins(), isqrt(seen["cells"]) + 1))
    model = fitted.fit(cells.withColumn("_cell", _cell_vector([F.col(n) for n in named], steps)))
    return Boosted(model, tuple(columns), tuple(map(tuple, thresholds)), tuple(steps))


@dataclass(frozen=True)
class Regression:
    scores: DataFrame  # model, r2, mae on the holdout
    importances: list[tuple[str, float]]
    predictions: DataFrame  # row key, actual, predicted, is_holdout
    parameters: dict[str, float]


def train(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    row_key: Sequence[str],
    parameters: Mapping[str, float] | None = None,
) -> Regression:
    """Fit both models on the same rows; the holdout never reaches ``fit``."""
    chosen = checked_parameters(parameters)
    if not features:
        raise LeakageError("Name one feature or more.")
    if target in features:
        raise LeakageError(f"'{target}' is the value being predicted; it cannot also be a feature.")
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise LeakageError(f"Unknown feature columns: {missing}")

    kind = df.select(t.column(target)).schema[0].dataType.typeName()
    exact = kind in ("byte", "short", "integer", "long", "double")  # the way through text would bring back the same number
    numeric_target = t.column(target).cast("double") if exact else t.column(target).cast("string").try_cast("double")
    wanted = list(dict.fromkeys([*row_key, *features]))
    rows = df.select(
        *[t.column(c) for c in wanted],
        numeric_target.alias("actual"),
        in_holdout(row_key, chosen["holdout"], int(chosen["seed"])).alias("is_holdout"),
    ).filter("actual is not null and not isnan(actual)")
    rows = materialise(rows, "regression-rows")  # medians, mean, categories and the coded rows read it
    fitted_on = rows.filter(~F.col("is_holdout"))

    prepared = prepare.fit(fitted_on, features, "actual", row_key, one_hot=True)
    ready = prepared.coded(rows, ~F.col("is_holdout")).select(*row_key, "actual", "is_holdout", *[t.column(c) for c in prepared.made])
    ready = materialise(ready, "regression")  # plain columns; vectors are put together by who reads them
    learn = ready.filter(~F.col("is_holdout"))
    linear = LinearRegression(labelCol="actual", featuresCol="wide", maxIter=100).fit(prepared.with_wide(learn).select("actual", "wide"))
    booster = GBTRegressor(
        labelCol="actual",
        seed=int(chosen["seed"]),
        maxIter=int(chosen["n_estimators"]),
        stepSize=float(chosen["learning_rate"]),
        maxDepth=5,
    )
    boosted = boost(booster, prepared.with_features(learn), prepared.read_by_trees)

    held = boosted.predicted(linear.setPredictionCol("linear").transform(prepared.with_wide(ready.filter("is_holdout"))), "gbm")
    long = held.select(
        "actual", F.stack(F.lit(2), F.lit("linear"), F.col("linear"), F.lit("gbm"), F.col("gbm")).alias("model", "predicted")
    )
    scores = evaluate.regression_scores(long, F.col("actual"), F.col("predicted"), ["model"])
    predictions = boosted.predicted(ready, "gbm").select(*row_key, "actual", F.bround("gbm", 2).alias("predicted"), "is_holdout")
    return Regression(scores, prepare.importances(boosted.model, prepared), predictions, chosen)
