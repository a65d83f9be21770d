"""Findings of round 3: passes over the rows, pairs that are measured, rows that teach."""

import datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from calibra.functions.frames import few_rows
from calibra.llm import exact_dedup, text
from calibra.operators import drift as D
from calibra.operators import models as ML
from calibra.operators import pivots
from calibra.operators import sampling as S
from calibra.plans import training


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [0, 3])
def test_training_rows_hold_no_hash(spark, sf_small, k):
    """Every pass of a fit worked out the split and fold hashes of all rows again."""
    train, test = training._split(spark, sf_small, k)
    assert "md5" not in plan(train) and "md5" not in plan(test)
    t = training.V.tx(spark, sf_small)
    old = S.stratified_split(t, "Class", training.V.TX_KEY, 0.2, "split42")
    kept = old.where("split = 'train'")
    if k:
        folds = S.fold_assignment(kept, "Class", training.V.TX_KEY, k, "fold42")
        assert sorted(train.groupBy("Class", "fold").count().collect()) == sorted(folds.groupBy("Class", "fold").count().collect())
    assert train.count() == kept.count()
    assert sorted(test.select(*training.V.TX_KEY).collect()) == sorted(old.where("split = 'test'").select(*training.V.TX_KEY).collect())


def test_tuning_equals_cross_validator_without_python(spark):
    """CrossValidator checks the fold of every row in Python; the scores are the same."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a + b + rng.normal() > 0.4), 1.0 + i % 2, i % 3)
            for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int, weight double, fold int").cache()
    est = ML.make_estimator("logistic_regression", "y", n=900, maxIter=20)
    maps = ML.grid("logistic_regression", est, {"regParam": [0.001, 0.5], "elasticNetParam": [0.0, 1.0]})
    found = ML.tune(df, ["a", "b"], "y", "logistic_regression", maps, est=est)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, foldCol="fold", numFolds=3, evaluator=MulticlassClassificationEvaluator(
        labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    assert found.avg_metrics == pytest.approx(cv.avgMetrics, rel=1e-12)
    assert found.best_model.coefficients.toArray() == pytest.approx(cv.bestModel.coefficients.toArray())
    with pytest.raises(ValueError):
        ML.tune(df.withColumn("fold", F.lit(1)), ["a", "b"], "y", "logistic_regression", maps, est=est)


def test_few_pairs_are_measured(monkeypatch):
    """A matrix product leaves only possible neighbours to be measured, whatever the vectors."""
    rng = np.random.default_rng(5)
    measured, real = [], np.einsum

    def counted(how, a, b):
        measured.append(a.size // a.shape[-1])
        return real(how, a, b)

    monkeypatch.setattr(np, "einsum", counted)
    ids = np.arange(400)
    for x in (rng.normal(size=(400, 16)), rng.normal(size=(400, 16)) + 1e5, rng.integers(0, 2, (400, 16)) * 1.0):
        measured.clear()
        row, col, d = pivots.nearest(x, ids, x, ids, np.full(400, np.inf), 5, True)
        every = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(every, np.inf)
        best = np.lexsort((np.broadcast_to(ids, every.shape), every))[:, :5]
        assert (col.reshape(400, 5) == best).all() and d.reshape(400, 5) == pytest.approx(np.take_along_axis(every, best, 1))
        assert sum(measured) < 400 * 400 / 4


def test_odd_vectors_have_the_neighbours_they_had():
    x = np.array([[0.0, 0], [1, 0], [np.nan, 0], [np.inf, 0], [3, 0]])
    ids = np.arange(5)
    row, col, _ = pivots.nearest(x, ids, x, ids, np.array([np.inf, 2.0, np.inf, np.inf, np.inf]), 2, True)
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 1), (0, 4), (1, 0), (1, 4), (4, 1), (4, 0)]
    huge = np.array([[1e200, 0], [1e200, 0], [0, 0]])
    row, col, _ = pivots.nearest(huge, np.arange(3), huge, np.arange(3), np.full(3, np.inf), 1, True)
    assert (row.tolist(), col.tolist()) == ([0, 1], [1, 0])


def test_histogram_sends_no_row_to_its_feature(spark):
    """The range was joined by feature: all rows went to a handful of tasks."""
    df = spark.createDataFrame([(float(i), float(i % 7), "reference" if i % 2 else "current") for i in range(100)],
                               "a double, b double, side string")
    h = D.histogram(df, ["a", "b"])
    assert "SortMergeJoin" not in plan(h) and "BroadcastHashJoin" in plan(h)
    assert h.agg(F.sum("count")).first()[0] == 200


def test_drift_reads_the_rows_once(spark, tmp_path):
    """Bounds, buckets and bucket totals were each worked out from all unpivoted rows."""
    rng = np.random.default_rng(11)
    rows = [(float(a), None if i % 9 == 0 else float("nan") if i % 9 == 1 else float(i % 5), ("reference", "current", None)[i % 3])
            for i, a in enumerate(rng.normal(size=600))]
    spark.createDataFrame(rows, "a double, b double, side string").write.parquet(f"{tmp_path}/rows")
    ks = D.ks_two_sample(spark.read.parquet(f"{tmp_path}/rows"), ["a", "b"], buckets=7)
    assert not [f for f in ks.inputFiles() if str(tmp_path) in f]
    found = {r.feature: r for r in ks.collect()}
    for k, name in enumerate(("a", "b")):
        ref, cur = (np.array([r[k] for r in rows if r[2] == s and r[k] is not None and r[k] == r[k]]) for s in ("reference", "current"))
        at = np.concatenate([ref, cur])
        gap = np.abs((ref[:, None] <= at).mean(0) - (cur[:, None] <= at).mean(0)).max()
        assert found[name].ks_statistic == pytest.approx(gap, abs=1e-12)
        assert (found[name].n_reference, found[name].n_current) == (len(ref), len(cur))


def test_few_rows_need_no_python_task(spark):
    """createDataFrame from a list started a second Python daemon with workers on every executor (pipeline)."""
    rows = spark.range(8).select("id", F.unhex(F.sha2((F.col("id") % 3).cast("string"), 256)).alias("d"))
    decided = exact_dedup.decide(rows, "id", "d", 2)
    assert "ExistingRDD" not in plan(decided)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in decided.collect()) == [
        (i, {0: 6, 1: 7, 2: 5}[i % 3], 2 if i % 3 == 2 else 3, i in (5, 6, 7)) for i in range(8)]
    kinds = "s string, b binary, l long, x array<double>, p decimal(9,2), t timestamp"
    row = ("a", bytearray(b"z"), None, [1.5, None, float("inf")], Decimal("1.25"), datetime.datetime(2024, 1, 2))
    for names in (kinds, kinds.rpartition(",")[0]):
        want = spark.createDataFrame([row[:len(names.split(", "))], (None,) * len(names.split(", "))], names)
        got = few_rows(spark, want.collect(), want.schema)
        assert got.schema == want.schema and got.collect() == want.collect()
    assert few_rows(spark, [], kinds).count() == 0


@pytest.mark.skipif(text.TRIM is None, reason="needs glibc")
def test_workers_give_memory_back(spark):
    """Freed blocks stayed in the workers' heaps, which live on beside the executor's (pipeline)."""
    def work(batches):
        pins = []
        for b in batches:
            resident = int(open("/proc/self/statm").read().split()[1]) * 4096
            blocks = [bytes(100_000) for _ in range(800)]
            pins.append(bytes(100_000))         # above the blocks: the heap's end can't sink
            del blocks
            yield pa.RecordBatch.from_pydict({"n": pa.array([resident] * b.num_rows, pa.int64())})

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "1")
    try:
        found = [r.n for r in text.map_batches(spark.range(3).coalesce(1), work, "n long").collect()]
    finally:
        spark.conf.set(size, before)
    assert len(found) == 3 and found[-1] - found[0] < 40e6
