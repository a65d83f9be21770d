"""The pivot kNN join: exact at every block size, with skew, and with less work than all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import pivots
from calibra.operators.neighbors import knn


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)],
                                 "id long, features array<double>")


def brute(q, qids, r, rids, k, exclude_self=True):
    out = {}
    for x, i in zip(q, qids, strict=True):
        d = np.sqrt(((r - x) ** 2).sum(1))
        near = sorted((d[j], rids[j]) for j in range(len(r)) if not (exclude_self and rids[j] == i))[:k]
        out.update({(i, rank + 1): (rid, round(float(dist), 9)) for rank, (dist, rid) in enumerate(near)})
    return out


def got(df):
    return {(r.q_id, r["rank"]): (r.nn_id, round(r.distance, 9)) for r in df.collect()}


def clustered(rng, n, d=8, clusters=20):
    centres = rng.normal(size=(clusters, d)) * 30
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))


@pytest.mark.parametrize("rows", [1, 7, 60, 4096])
def test_every_block_size_is_exact(spark, rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([clustered(rng, 150, 4, 5), rng.normal(size=(50, 4)) * 100])
    df = frame(spark, x).repartition(3)
    out = pivots.knn_join(df, df, 4, "id", "features", True, [], rows)
    assert got(out) == brute(x, range(200), x, range(200), 4)


def test_copies_and_far_queries(spark):
    rng = np.random.default_rng(2)
    # a third of the rows are one vector; some queries lie far from all rows, or have no vector
    x = np.concatenate([np.zeros((100, 3)), rng.integers(0, 3, (200, 3)).astype(float)])
    q = np.concatenate([x[::7], rng.normal(size=(5, 3)) * 1e4])
    qids = [*range(0, 300, 7), *range(9000, 9005)]
    out = pivots.knn_join(frame(spark, [*q, None], [*qids, 7777]), frame(spark, [*x, None], [*range(300), 8888]), 5, "id",
                          "features", True, [], 20)
    assert got(out) == brute(q, qids, x, range(300), 5)
    kept = pivots.knn_join(frame(spark, q, qids), frame(spark, x), 5, "id", "features", False, [], 20)
    assert got(kept) == brute(q, qids, x, range(300), 5, exclude_self=False)


def test_fewer_rows_than_neighbours_and_busy_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    monkeypatch.setattr(pivots, "COPY_ROWS", 3)      # every block is copied
    df = frame(spark, x)
    assert got(pivots.knn_join(df, df, 60, "id", "features", True, [], 10)) == brute(x, range(40), x, range(40), 60)


def test_clustered_data_needs_a_fraction_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 3000)
    df, report = frame(spark, x).repartition(4), {}
    out = got(pivots.knn_join(df, df, 5, "id", "features", True, [], 60, report))
    sample = range(0, 3000, 29)
    want = brute(x[list(sample)], sample, x, range(3000), 5)
    assert {key: out[key] for key in want} == want and len(out) == 15000
    assert report["blocks"] > 20 and report["pairs"] < 3000 * 3000 / 4


def test_no_side_is_collected_and_labels_travel(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = clustered(rng, 500, 4)
    df = frame(spark, x).withColumn("label", F.concat(F.lit("c"), F.col("id") % 3))
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    collect = Classic.collect

    def watch(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(Classic, "collect", watch)
    out = knn(df, df, 3, max_shipped_values=4 * 25, carry=["label"])
    plan = out._jdf.queryExecution().toString()
    assert max(seen) <= 100                                   # pivots, rings and counts only
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BroadcastExchange" not in plan
    assert all(r.label == f"c{r.nn_id % 3}" for r in collect(out))
