"""Checks that need no reference score: shuffled outcomes and give-away columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.functions.draws import draw
from tablewright.functions.prefix import running_totals
from tablewright.ml import evaluate, tiers
from tablewright.relational import features as windowed
from tablewright.relational.spec import DatasetSpec, RelationalError, TaskSpec
from tablewright.session import materialise

GIVEAWAY_AUROC = 0.95
FEWEST_ROWS = 10
ATTEMPTS = 20


def _numbered(df: DataFrame, order: Sequence[str], number: str) -> DataFrame:
    """Rows numbered along one global order, without a one-task sort."""
    ones = df.withColumn("one", F.lit(1).cast("bigint"))
    return running_totals(ones, [], order, ["one"]).drop("one").withColumnRenamed("run_one", number)


def permuted_labels(training: DataFrame, entity: str, seed: int) -> DataFrame:
    """The same rows with the labels dealt out in another order."""
    keys = [entity, "as_of"]
    rows = _numbered(training, keys, "place")
    dealt = training.select("label", *keys, draw(keys, seed).alias("draw"))
    dealt = _numbered(dealt, ["draw", *keys], "place").select("place", F.col("label").alias("dealt"))
    return rows.drop("label").join(dealt, "place").withColumnRenamed("dealt", "label").drop("place")


def shuffled_training(training: DataFrame, entity: str, seed: int) -> DataFrame:
    """Permuted labels, dealt again until every split has both classes."""
    training = materialise(training, "dealt-from")  # read by every deal, twice
    for attempt in range(ATTEMPTS):
        shuffled = materialise(permuted_labels(training, entity, seed + attempt), "shuffled")
        kinds = shuffled.groupBy("split").agg(F.count_distinct("label").alias("kinds"))
        if kinds.agg(F.min("kinds").alias("least")).first()["least"] >= 2:  # three rows
            return shuffled
    raise RelationalError(f"{ATTEMPTS} deals left a split with one class of labels only")


def shuffled_label_canary(
    spec: DatasetSpec,
    task: TaskSpec,
    frames: Mapping[str, DataFrame],
    training: DataFrame,
    seed: int,
    trees: int = tiers.TREES,
    paths=None,
) -> DataFrame:
    """Test AUROC of the baseline on shuffled labels; honest wiring scores near 0.5."""
    shuffled = shuffled_training(training, task.entity_column, seed)
    matrix = materialise(windowed.feature_matrix(spec, task, frames, shuffled, paths), "canary")  # the fit reads it several times
    scored = tiers.fit_tier(matrix, task, windowed.feature_columns(task, matrix), seed, trees)
    return evaluate.ranking_scores(scored.filter(F.col("split") == "test"), "likelihood", "label")


def column_scores(training: DataFrame, entity_rows: DataFrame, entity: str, candidates: Sequence[str]) -> DataFrame:
    """How well each entity column alone ranks the outcome.

    Numbers rank by value, anything else by the mean label of its value.  All
    columns are counted in one pass; a column needs ten scored rows and both
    classes.
    """
    kinds = {f.name: f.dataType for f in entity_rows.schema.fields}
    present = [c for c in candidates if c in kinds]
    joined = training.select(entity, "label").join(
        entity_rows.select(entity, *[t.column(c).alias(f"v_{i}") for i, c in enumerate(present)]), entity
    )
    cells = []
    for i, c in enumerate(present):
        numeric = t.domain_type(kinds[c]) in t.NUMERIC
        number = F.col(f"v_{i}").cast("double") if numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if numeric else t.as_text(f"v_{i}", kinds[c])
        cells += [F.lit(c), number, text, F.col("label").cast("int")]
    long = joined.select(F.stack(F.lit(len(present)), *cells).alias("column_name", "number", "txt", "label"))
    counted = (
        long.filter("number is not null or txt is not null")
        .groupBy("column_name", "number", "txt")
        .agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    )
    scored = counted.select(
        "column_name", F.coalesce("number", F.col("pos") / F.col("n")).alias("score"), "pos", "n"
    )
    per_score = scored.groupBy("column_name", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    per_score = per_score.withColumn("neg", F.col("n") - F.col("pos"))
    run = running_totals(per_score, ["column_name"], ["score"], ["neg"])
    pos = F.col("pos").cast("double")
    wins = pos * (F.col("run_neg") - 0.5 * F.col("neg"))
    per_column = run.groupBy("column_name").agg(
        F.sum("n").alias("scored_rows"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(wins).alias("wins"),
    )
    enough = (F.col("scored_rows") >= FEWEST_ROWS) & (F.col("positives") > 0) & (F.col("negatives") > 0)
    auroc = F.when(enough, F.col("wins") / (F.col("positives").cast("double") * F.col("negatives")))
    return per_column.select("column_name", "scored_rows", auroc.alias("auroc")).withColumn(
        "is_giveaway", F.coalesce(F.greatest("auroc", 1 - F.col("auroc")) >= GIVEAWAY_AUROC, F.lit(False))
    )


def giveaway_columns(training: DataFrame, entity_rows: DataFrame, entity: str, candidates: Sequence[str]) -> list[str]:
    found = column_scores(training, entity_rows, entity, candidates).filter("is_giveaway").collect()
    flagged = {r["column_name"] for r in found}  # at most one row per column
    return [c for c in candidates if c in flagged]
