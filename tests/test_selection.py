"""Selection by narrowing: exact cuts and order statistics, and splits without a row exchange."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import selection
from calibra.functions.selection import beyond, key_cuts, order_statistics
from calibra.operators import features as FE
from calibra.operators import sampling as S


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)


def values_of(kind, rng):
    return {
        "normal": rng.normal(size=9000),
        "ties": rng.integers(0, 5, 9000).astype(float),
        "one": np.full(9000, 3.25),
        "scales": 10.0 ** rng.uniform(-300, 300, 9000) * rng.choice([-1, 1], 9000),
        "outliers": np.concatenate([rng.normal(size=8990), [1e300, -1e300, 1e308, 1e18, -1e17, 5, 5, 5, 5, 5]]),
        "neighbours": 1e15 + np.arange(9000) * 0.125,
        "small": rng.normal(size=11),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "scales", "outliers", "neighbours", "small"])
def test_order_statistics_equal_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "FETCHED", 20)       # narrow to the end
    x = values_of(kind, np.random.default_rng(1))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found, missing = order_statistics(column(spark, [*x, None, float("nan")]), {"x": probs})
    order = np.sort(x)
    for p in probs:
        at = (len(x) - 1) * p
        lower, upper, fraction = found["x"][p]
        assert (lower, upper) == (order[math.floor(at)], order[math.ceil(at)]) and fraction == at - math.floor(at)
    assert missing == {"x": 2}


def test_infinities_and_columns_without_values(spark):
    df = column(spark, [float("inf")] * 3 + [float("-inf")] * 2 + list(range(5000))).withColumn(
        "y", F.lit(None).cast("double"))
    found, missing = order_statistics(df, {"x": [0.0, 0.5, 1.0], "y": [0.5]})
    order = sorted([float("inf")] * 3 + [float("-inf")] * 2 + list(range(5000)))
    assert [found["x"][p][0] for p in (0.0, 0.5, 1.0)] == [order[0], order[2502], order[-1]]
    assert "y" not in found and missing["y"] == 5005
    assert FE.exact_quantiles(df, ["y"], [0.5]).collect() == []


@pytest.mark.parametrize("modulus", [1, 7, 2 ** 32])
def test_cuts_equal_sorting(spark, modulus):
    """Few values of u make ties that keys decide."""
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][rng.integers(0, 3)], int(rng.integers(0, 2 ** 32) % modulus), int(k), f"s{k % 3}")
            for k in rng.permutation(900)]
    df = spark.createDataFrame(rows, "c string, u long, k long, s string").repartition(4)
    own = {c: sorted((u, s, k) for x, u, k, s in rows if x == c) for c in ("a", "b")}
    wanted = {c: [1, 17, len(own[c]) // 2, len(own[c])] for c in own}
    cuts = key_cuts(df, "c", F.col("u"), ["s", "k"], wanted)
    for c, ranks in wanted.items():
        assert [cuts[c][r] for r in ranks] == [own[c][r - 1] for r in ranks]
        after = df.where(F.col("c") == c).where(beyond(df, F.col("u"), ["s", "k"], cuts[c][17])).count()
        assert after == len(own[c]) - 17
    with pytest.raises(ValueError, match="fewer"):
        key_cuts(df, "c", F.col("u"), ["s", "k"], {"a": [10 ** 6]})


def test_splits_are_projections_of_the_scan(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).cast("string").alias("c"), F.lit("wide").alias("w"))
    for out in (S.stratified_split(df, "c", ["id"]), S.three_way_split(df, "c", ["id"]), S.fold_assignment(df, "c", ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "InMemory" not in plan
        assert out.columns[:3] == ["id", "c", "w"] and out.count() == 5000


def test_many_folds_and_small_classes(spark):
    df = spark.createDataFrame([(i, "big" if i < 97 else "two" if i < 99 else None) for i in range(101)], "id long, c string")
    sizes = {}
    for r in S.fold_assignment(df, "c", ["id"], 10).collect():
        sizes.setdefault(r.c, []).append(r.fold)
    assert sorted(np.bincount(sizes["big"], minlength=10)) == [9, 9, 9] + [10] * 7
    assert sorted(sizes["two"]) == [0, 1]
    assert sizes[None] == [0, 0]


def test_repeated_keys_stay_together(spark):
    df = spark.createDataFrame([(i // 4, "c") for i in range(400)], "id long, c string")
    parts = {}
    for r in S.stratified_split(df, "c", ["id"], 0.25).collect():
        parts.setdefault(r.id, set()).add(r.split)
    assert all(len(p) == 1 for p in parts.values())
    assert 25 <= sum(p == {"test"} for p in parts.values()) <= 26


def test_robust_scaler_makes_no_exchange_of_values(spark):
    df = column(spark, np.random.default_rng(3).normal(size=5000))
    model = FE.RobustScaler(["x"]).fit(df)
    assert "Exchange" not in model.transform(df.coalesce(1))._jdf.queryExecution().executedPlan().toString().split("Coalesce")[0]
    with pytest.raises(ValueError, match="NaN"):
        FE.RobustScaler(["x"]).fit(column(spark, [1.0, None]))
