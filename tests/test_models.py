from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.ml import evaluate, honesty, prepare, regression, tiers
from tablewright.suite import training as tr


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(scores, labels):
    total, out, hits, seen = sum(labels), 0.0, 0, 0
    for s in sorted(set(scores), reverse=True):
        here = [y for x, y in zip(scores, labels) if x == s]
        hits, seen = hits + sum(here), seen + len(here)
        out += sum(here) / total * hits / seen
    return out


def test_ranking_scores_with_ties(many_slices):
    rng = random.Random(1)
    data = [("a" if i % 3 else "b", round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(1500)]
    df = many_slices.createDataFrame(data, "g string, score double, label int")
    for r in evaluate.ranking_scores(df, by=["g"]).collect():
        part = [(s, y) for g, s, y in data if g == r["g"]]
        assert r["auroc"] == pytest.approx(brute_auc(*zip(*part)))
        assert r["average_precision"] == pytest.approx(brute_ap(*zip(*part)))
    whole = evaluate.ranking_scores(df).first()
    assert whole["auroc"] == pytest.approx(brute_auc([d[1] for d in data], [d[2] for d in data]))


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert evaluate.ranking_scores(df).first()["auroc"] is None


def test_regression_scores(spark):
    y, p = np.array([1.0, 2, 3, 4]), np.array([1.5, 2, 2, 5])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double")
    (got,) = evaluate.regression_scores(df, F.col("y"), F.col("p")).collect()
    assert got["r2"] == round(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 4) and got["mae"] == round(np.abs(y - p).mean(), 2)


def test_parameters_are_bounded():
    assert regression.checked_parameters({})["n_estimators"] == 400
    for bad in ({"n_estimators": 10}, {"learning_rate": 0.9}, {"holdout": 0.5}, {"depth": 3}):
        with pytest.raises(ValueError):
            regression.checked_parameters(bad)


def test_leakage_is_refused(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double")
    for features in ([], ["y", "x"], ["nope"]):
        with pytest.raises(regression.LeakageError):
            regression.train(df, "y", features, ["id"])


def test_holdout_is_stable(spark):
    df = spark.range(5000)
    split = df.withColumn("h", regression.in_holdout(["id"], 0.2, 42))
    again = df.repartition(13).withColumn("h", regression.in_holdout(["id"], 0.2, 42))
    assert split.exceptAll(again).count() == 0
    assert 850 < split.filter("h").count() < 1150
    other = df.withColumn("h", regression.in_holdout(["id"], 0.2, 43))
    assert split.exceptAll(other).count() > 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        x, kind = rng.random() * 10, rng.choice(["a", "b", "c"])
        y = 3 * x + {"a": 0, "b": 10, "c": 20}[kind] + rng.gauss(0, 0.5)
        data.append((i, x if i % 20 else None, kind, rng.random(), str(y) if i != 7 else "n/a"))
    df = spark.createDataFrame(data, "id int, x double, kind string, noise double, y string")
    return regression.train(df, "y", ["x", "kind", "noise"], ["id"], {"n_estimators": 50})


def test_both_models_score(fitted):
    scores = {r["model"]: r for r in fitted.scores.collect()}
    assert scores["linear"]["r2"] > 0.8 and scores["gbm"]["r2"] > 0.3


def test_every_row_is_predicted(fitted):
    assert fitted.predictions.count() == 399  # the row without a numeric target is out
    assert fitted.predictions.filter("predicted is null").count() == 0
    assert fitted.predictions.columns == ["id", "actual", "predicted", "is_holdout"]


def test_importances_belong_to_source_features(fitted):
    assert {f for f, _ in fitted.importances} <= {"x", "kind", "noise"}
    assert sum(v for _, v in fitted.importances) == pytest.approx(1, abs=0.01)
    assert fitted.importances[-1][0] == "noise"


def test_trees_of_cells_are_the_trees_of_their_rows(spark):
    """12,000 rows in fewer cells: the same bins, splits, importances and predictions, also in bins that no training row fills."""
    data = [(float(h % 97), (-1.0) ** i * (1 + h % 40), float(i % 5), 7.0, (h % 97) ** 2.0 + (50.0 if i % 5 > 2 else 0) * (h % 40)) for i, h in ((i, i * 7919 % 10007) for i in range(12000))]
    columns = ["many", "signed", "few", "same"]
    rows_ = spark.createDataFrame(data, [*columns, "actual"]).withColumn("features", regression.array_to_vector(F.array(*columns))).coalesce(1)
    booster = regression.GBTRegressor(labelCol="actual", seed=42, maxIter=8, stepSize=0.3, maxDepth=5)
    plain, cells = booster.fit(rows_), regression.boost(booster, rows_, columns)
    assert cells.model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-9)
    assert cells.model.trees[0].depth == plain.trees[0].depth and [len(t) for t in cells.thresholds][0] == 31
    new = spark.createDataFrame([(v, w, f, s) for v in (-5.0, 3.5, 96.0, 200.0) for w in (-99.0, -0.4, 0.0, 0.3, 12.0) for f in (0.0, 9.0) for s in (7.0, 8.0)], columns)
    asked = rows_.select(*columns).union(new).withColumn("features", regression.array_to_vector(F.array(*columns)))
    both = cells.predicted(plain.setPredictionCol("by_rows").transform(asked), "by_cells").select("by_rows", "by_cells").collect()
    assert len(both) == 12080 and [r["by_cells"] for r in both] == pytest.approx([r["by_rows"] for r in both])


def test_trees_are_fitted_on_cells(spark, monkeypatch):
    fitted_on, fit = [], regression.GBTRegressor.fit
    monkeypatch.setattr(regression.GBTRegressor, "fit", lambda self, df, *more: fitted_on.append(df.count()) or fit(self, df, *more))
    df = spark.range(4000).selectExpr("id", "id % 10 AS x", "concat('k', id % 3) AS k", "CAST(id % 10 + id % 7 AS DOUBLE) AS y")
    found = regression.train(df, "y", ["x", "k"], ["id"], {"n_estimators": 50})
    assert found.predictions.count() == 4000 and len(fitted_on) == 1 and fitted_on[0] <= 10 * 3 * prepare.FOLDS


def test_preparation_learns_from_train_only(spark):
    train = spark.createDataFrame([(1, 1.0, "a", 10.0), (2, 3.0, "b", 40.0), (3, None, "a", 22.0), (4, 2.0, None, 8.0)], "id int, x double, k string, y double")
    ready = prepare.fit(train, ["x", "k"], "y", ["id"], one_hot=True)
    assert ready.medians == {"x": 2.0} and ready.prior == 20.0 and ready.inputs == ["x", "k"]
    new = spark.createDataFrame([(9, None, "never seen"), (9, 100.0, "b"), (9, 5.0, "a"), (9, 6.0, "")], "id int, x double, k string")
    got = sorted((list(r["wide"].toArray()), list(r["features"].toArray())) for r in ready.apply(new).collect())
    assert [w for w, _ in got] == [[2.0, 0, 0, 0], [5.0, 0, 1, 0], [6.0, 1, 0, 0], [100.0, 0, 0, 1]]
    codes = [c for _, (_, c) in got]
    assert codes == pytest.approx([20.0, (32 + 200) / 12, (8 + 200) / 11, (40 + 200) / 11])


def test_a_training_row_does_not_see_its_own_target(spark):
    """A key with one row per value says nothing: every training row gets the plain mean, whatever its target."""
    data = [(i, f"k{i}", "x" if i % 2 else "y", float(i % 2)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, unique string, kind string, y double")
    ready = prepare.fit(df, ["unique", "kind"], "y", ["id"])
    rows_ = ready.apply(df, F.lit(True)).select("kind", "unique_code", "kind_code").collect()
    assert {round(r["unique_code"], 9) for r in rows_} == {0.5}
    folds = {r["id"]: r["f"] for r in df.select("id", prepare.fold_of(["id"]).alias("f")).collect()}
    for r, (i, _, kind, _) in zip(sorted(ready.apply(df, F.lit(True)).collect(), key=lambda r: r["id"]), data):
        others = [y for j, _, k, y in data if k == kind and folds[j] != folds[i]]
        assert r["kind_code"] == pytest.approx((sum(others) + 5) / (len(others) + 10))


def test_many_values_are_prepared_like_few(spark):
    """No number of values switches to another preparation."""
    df = spark.range(30000).selectExpr("id", "concat('v', id % 6000) AS k", "CAST(id % 6000 AS DOUBLE) AS y")
    ready = prepare.fit(df, ["k"], "y", ["id"], one_hot=True)
    seen = ready.apply(df.filter("id < 6000"))
    assert seen.select("k_place").distinct().count() == 6000
    vector = seen.filter("id = 17").first()["wide"]
    assert vector.size == 6000 and vector.numNonzeros() == 1
    assert seen.filter("id = 17").first()["k_code"] == pytest.approx((5 * 17 + 10 * 2999.5) / 15)


def test_permuted_labels_keep_rows_and_counts(many_slices):
    data = [(i, f"2020-01-{1 + i % 28:02d}", int(i % 4 == 0), "train" if i % 2 else "test") for i in range(2000)]
    df = many_slices.createDataFrame(data, "id int, as_of string, label int, split string")
    mixed = honesty.permuted_labels(df, "id", 3)
    assert mixed.count() == 2000 and mixed.filter("label = 1").count() == 500
    assert mixed.select("id", "as_of", "split").exceptAll(df.select("id", "as_of", "split")).count() == 0
    changed = mixed.alias("m").join(df.alias("d"), "id").filter("m.label <> d.label").count()
    assert 600 < changed < 900
    assert honesty.permuted_labels(df.repartition(9), "id", 3).exceptAll(mixed).count() == 0


def test_giveaway_columns(spark):
    rng = random.Random(9)
    data = [(i, float(i % 2) * 10 + rng.random(), rng.random(), "yes" if i % 2 else "no", rng.choice("xyz"), None) for i in range(100)]
    entity = spark.createDataFrame(data, "id int, closed double, size double, outcome string, colour string, empty double")
    training = spark.createDataFrame([(i, i % 2) for i in range(100)], "id int, label int")
    names = ["closed", "size", "outcome", "colour", "empty", "missing"]
    assert honesty.giveaway_columns(training, entity, "id", names) == ["closed", "outcome"]
    few = honesty.column_scores(training.filter("id < 8"), entity, "id", ["closed"])
    assert rows(few, "auroc", "is_giveaway") == [(None, False)]


def test_patience_outlasts_a_plateau():
    curve = [1.0 - 0.01 * i for i in range(10)] + [0.92] * 30 + [0.80 - 0.001 * i for i in range(20)] + [0.9] * 200 + [0.1]
    assert tiers.trees_kept(curve, 50) == 60  # a tolerance per tree would have stopped at the plateau after ten
    assert tiers.trees_kept(curve, 20) == 10
    assert tiers.trees_kept([0.5], 50) == 1 and tiers.trees_kept([0.5, 0.5, 0.4], 50) == 3


def test_a_truncated_model_sums_its_first_trees(spark):
    rng = random.Random(3)
    data = [(Vectors.dense([rng.random(), rng.random()]), 0.0) for _ in range(400)]
    data = [(v, float(v[0] + 0.3 * rng.random() > 0.6)) for v, _ in data]
    df = spark.createDataFrame(data, ["features", "label"])
    model = GBTClassifier(labelCol="label", maxIter=9, stepSize=0.3, seed=5).fit(df)
    short = tiers.truncated(model, 4)
    assert short.getNumTrees == 4 and model.getNumTrees == 9
    for r in short.transform(df.limit(20)).collect():
        margin = sum(w * t.predict(r["features"]) for w, t in zip(model.treeWeights[:4], model.trees[:4]))
        assert r["probability"][1] == pytest.approx(1 / (1 + np.exp(-2 * margin)))
    again = GBTClassifier(labelCol="label", maxIter=4, stepSize=0.3, seed=5).fit(df)
    assert rows(again.transform(df), "prediction") == rows(short.transform(df), "prediction")


def _matrix(spark, n=80, walked=False):
    split = F.element_at(F.lit(["train", "val", "test"]), (F.col("id") % 3 + 1).cast("int"))
    made = spark.range(n).select(
        F.col("id").alias("customer_id"), F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("as_of"),
        split.alias("split"), (F.col("id") % 7 < 3).cast("int").alias("label"), (F.col("id") * 1.5).alias("w" if walked else "v"),
    )
    return made.drop("split", "label") if walked else made


def test_the_canary_computes_its_features_once(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counted(spec, task, frames, training, paths):
        @F.udf("double")
        def met_once(v):
            met.add(1)
            return v

        return training.withColumn("v", met_once.asNondeterministic()("v"))

    monkeypatch.setattr(honesty.windowed, "feature_matrix", counted)
    scores = honesty.shuffled_label_canary(tr.SPEC, tr.ADOPTS, {}, _matrix(spark), 13, trees=2)
    assert scores.first()["positives"] > 0 and met.value == 80


def test_every_tier_reads_a_written_matrix(spark, monkeypatch):
    plans, fit = {}, tiers.fit_tier

    def noted(matrix, task, columns, seed, trees):
        plans[len(columns), columns[0]] = matrix._jdf.queryExecution().optimizedPlan().toString()
        return fit(matrix, task, columns, seed, trees)

    monkeypatch.setattr(tiers.windowed, "feature_matrix", lambda spec, task, frames, training, paths: training)
    monkeypatch.setattr(tiers.neighbors, "graph_features", lambda spec, *rest: _matrix(spark, walked=True))
    monkeypatch.setattr(tiers, "fit_tier", noted)
    found = tiers.compare(tr.SPEC, tr.ADOPTS, {}, _matrix(spark), trees=2)
    assert {r["tier"] for r in found.metrics.collect()} == {"graph", "baseline", "hybrid"}
    assert plans and not any("Join" in p for p in plans.values())


def test_all_tiers_read_one_written_matrix(spark, monkeypatch):
    """the features of both kinds are written once, together; large dictionaries still write the prepared rows."""
    written, keep = [], tiers.materialise
    monkeypatch.setattr(tiers, "materialise", lambda df, label: written.append(label) or keep(df, label))
    texts = lambda spec, task, frames, training, paths: training.withColumn("kind", F.concat(F.lit("k"), F.col("v") % 4))
    monkeypatch.setattr(tiers.windowed, "feature_matrix", texts)
    monkeypatch.setattr(tiers.neighbors, "graph_features", lambda spec, *rest: _matrix(spark, walked=True))
    found = [rows(tiers.compare(tr.SPEC, tr.ADOPTS, {}, _matrix(spark), trees=2).metrics)]
    assert written == ["training", "rows", "graph", "baseline", "hybrid", "metrics", "predictions"]
    monkeypatch.setattr(prepare, "FEW_VALUES", 0)
    found.append(rows(tiers.compare(tr.SPEC, tr.ADOPTS, {}, _matrix(spark), trees=2).metrics))
    assert found[0] == found[1] and written.count("tier") == 2  # the graph alone has no texts
