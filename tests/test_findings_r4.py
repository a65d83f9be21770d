"""Findings of round 4: tree models of train_models grow from counted rows."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from calibra.operators import models as ML
from calibra.operators import trees

FEATURES = ["a", "b", "c", "d", "same"]
PARAMS = {"random_forest": {"numTrees": 7, "maxDepth": 4}, "xgboost": {"maxIter": 4, "maxDepth": 3}}


def made_rows(spark, path, n, seed=1):
    """Rows of wide, narrow, mostly zero and constant features in several files, with two weights."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n) / 4.0 - 0.5, np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n))
    y = (a + b + c + rng.normal(size=n) > 0.6).astype(int)
    rows = zip(*(v.tolist() for v in (a, b, c, rng.exponential(size=n), y, np.where(y == 1, 1.7, 0.6))), strict=True)
    df = spark.createDataFrame(list(rows), "a double, b double, c double, d double, y int, weight double")
    df.withColumn("same", F.lit(3.0)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n", [3_000, 25_000])
def test_grown_trees_are_those_of_the_estimators(spark, tmp_path, n):
    """With and without a sample of split candidates: leaves, draws and features of every node (F1)."""
    df = made_rows(spark, f"{tmp_path}/rows", n)
    ests = {k: ML.make_estimator(k, "y", **p) for k, p in PARAMS.items()}
    assert all(trees.grows(e, len(FEATURES)) for e in ests.values())
    cells = trees.count_cells(df, FEATURES, "y", ests)
    x = np.array(df.select(*FEATURES).collect(), float)
    for kind, est in ests.items():
        grown = trees.fit(cells, est, kind)
        made = ML.fit_model(df, FEATURES, "y", kind, **PARAMS[kind])
        want = made.transform(df).select("rawPrediction", "prediction").collect()
        raw, said = grown.raw(grown.bins(x)), [r.prediction for r in grown.transform(df).collect()]
        assert raw[:, -1] == pytest.approx([r.rawPrediction[1] for r in want], abs=1e-9)
        assert said == [r.prediction for r in want]


def test_tree_models_read_the_rows_once(spark, tmp_path, monkeypatch):
    """Every level of every tree passed over all rows, which were kept in the executors' heaps (F1)."""
    df = made_rows(spark, f"{tmp_path}/rows", 2_000)
    passes, counted = [], []
    real_fit, real_count = ML.fit_model, trees.count_cells
    monkeypatch.setattr(ML, "fit_model", lambda *a, **k: passes.append(a[3]) or real_fit(*a, **k))
    monkeypatch.setattr(trees, "count_cells", lambda *a, **k: counted.append(list(a[3])) or real_count(*a, **k))
    rows = {r[0]: r for r in ML.train_many(df, df, FEATURES, "y", svm={"maxIter": 5}, logistic_regression={"maxIter": 5}, **PARAMS)}
    assert passes == ["logistic_regression", "svm"] and counted == [["random_forest", "xgboost"]]
    assert list(rows) == ML.MODEL_TYPES and all(r[1] == "SUCCESS" and 0.5 < r[2] <= 1 for r in rows.values())
    whole = df.groupBy("y").count().collect()
    cells = real_count(df, FEATURES, "y", {"xgboost": ML.make_estimator("xgboost", "y", maxIter=2, subsamplingRate=1.0)})
    assert {r.y: r.s for r in cells.rows.groupBy("y").agg(F.sum("xgboost1").alias("s")).collect()} == {r.y: r["count"] for r in whole}


def test_trees_too_many_or_deep_are_fitted_as_before(spark):
    assert not trees.grows(ML.make_estimator("random_forest"), 4)
    assert not trees.grows(ML.make_estimator("svm"), 4)
    assert trees.grows(ML.make_estimator("random_forest", numTrees=20, maxDepth=5), 4)


def test_bad_rows_fail_their_models_alone(spark, tmp_path):
    df = made_rows(spark, f"{tmp_path}/rows", 400)
    three = df.withColumn("y", F.when(F.col("a") > 1, 2).otherwise(F.col("y")))
    states = {r[0]: r[1] for r in ML.train_many(three, three, FEATURES, "y", ["random_forest", "xgboost"], **PARAMS)}
    assert states == {"random_forest": "SUCCESS", "xgboost": "FAILED"}
    empty = df.withColumn("d", F.when(F.col("a") > 1, None).otherwise(F.col("d")))
    for train, test in ((empty, df), (df, empty)):
        assert {r[1] for r in ML.train_many(train, test, FEATURES, "y", ["random_forest", "xgboost"], **PARAMS)} == {"FAILED"}


def test_evaluation_equals_the_evaluator(spark):
    """Two passes over scored rows as objects; one count gives the same (F1)."""
    pairs = [(0, 0.0)] * 5 + [(0, 1.0)] * 2 + [(1, 1.0)] * 3 + [(1, 0.0)] + [(2, 0.0)] * 2 + [(0, 3.0)]
    ev = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction")
    df = spark.createDataFrame(pairs, "y int, prediction double")
    for pred in (df, df.where("y = 2")):
        assert ML.evaluate(pred, "y") == pytest.approx({"weighted_f1": ev.evaluate(pred, {ev.metricName: "weightedFMeasure"}),
                                                        "accuracy": ev.evaluate(pred, {ev.metricName: "accuracy"})})
    none = ML.evaluate(df.where("y = 9"), "y")
    assert none["weighted_f1"] == 0 and math.isnan(none["accuracy"])
    with pytest.raises(ValueError):
        ML.evaluate(df.withColumn("y", F.lit(None).cast("int")), "y")
