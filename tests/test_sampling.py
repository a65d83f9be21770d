"""Splits, folds, kNN and oversampling: exactness and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import neighbors as NB
from calibra.operators import sampling as S


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    n = 1003
    y = (rng.random(n) < 0.1).astype(int)
    return spark.createDataFrame([(i, int(y[i])) for i in range(n)], "id long, Class int")


def test_stratified_split_exact_disjoint_complete(spark, labelled):
    out = S.stratified_split(labelled, "Class", ["id"], 0.2, "s1").cache()
    counts = {(r.split, r.Class): r["count"] for r in out.groupBy("split", "Class").count().collect()}
    n = {c: r for c, r in labelled.groupBy("Class").count().collect()}
    total_test = counts.get(("test", 0), 0) + counts.get(("test", 1), 0)
    assert total_test == int(np.ceil(0.2 * sum(n.values())))
    for c in n:
        assert abs(counts[("test", c)] - 0.2 * n[c]) < 1.0
    assert out.count() == labelled.count()
    assert out.select("id").distinct().count() == labelled.count()
    # sticky: same answer with another partitioning
    again = S.stratified_split(labelled.repartition(17), "Class", ["id"], 0.2, "s1")
    assert sorted(out.collect()) == sorted(again.collect())


def test_three_way_split_sizes(spark, labelled):
    out = S.three_way_split(labelled, "Class", ["id"], 0.2, 0.2, "s2")
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c["test"] == int(np.ceil(0.2 * 1003))
    assert abs(c["val"] - 0.2 * 1003) <= 2 and sum(c.values()) == 1003


def test_fold_sizes_balanced_per_class(spark, labelled):
    out = S.fold_assignment(labelled, "Class", ["id"], 5, "s3")
    per = out.groupBy("Class", "fold").count().collect()
    for cls in (0, 1):
        sizes = sorted(r["count"] for r in per if r.Class == cls)
        assert len(sizes) == 5 and sizes[-1] - sizes[0] <= 1


def _points(spark, n=120, d=4, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    lab = (rng.random(n) < 0.25).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(n)],
                               "id long, features array<double>, Class int")
    return df, x, lab


@pytest.mark.parametrize("mode", ["ship_query", "ship_reference", "slices"])
def test_knn_matches_bruteforce(spark, mode):
    df, x, _ = _points(spark)
    if mode == "ship_query":
        ref_ids, limit = np.arange(len(x)), 10 ** 9
    elif mode == "ship_reference":  # query side over the bound, reference side under it
        ref_ids, limit = np.arange(60), 300
    else:  # both sides over the bound: the query side is processed in slices
        ref_ids, limit = np.arange(len(x)), 200
    ref = df.where(F.col("id") < int(ref_ids.max()) + 1).repartition(3)
    got = NB.knn(df, ref, 4, "id", "features", max_shipped_values=limit)
    got = {(r.q_id, r["rank"]): r.nn_id for r in got.collect()}
    d = np.sqrt(((x[:, None, :] - x[None, ref_ids, :]) ** 2).sum(-1))
    for q in range(len(x)):
        if q in ref_ids:
            d[q, q] = np.inf
        order = ref_ids[np.lexsort((ref_ids, d[q]))[:4]]
        assert [got[(q, k + 1)] for k in range(4)] == order.tolist()


def test_smote_parity_and_convexity(spark):
    df, x, lab = _points(spark)
    out = NB.smote(df, "Class", "id", "features", k=3).cache()
    counts = {r.Class: r["count"] for r in out.groupBy("Class").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic").collect()
    assert len(syn) == (lab == 0).sum() - (lab == 1).sum()
    for r in syn:
        a, b = x[r.base_id], x[r.neighbour_id]
        assert lab[r.base_id] == 1 and lab[r.neighbour_id] == 1
        assert 0.0 <= r.gap < 1.0
        assert np.allclose(np.asarray(r.features), a + r.gap * (b - a))


def test_borderline_and_adasyn(spark):
    df, x, lab = _points(spark)
    dz = NB.borderline_danger(df, "Class", "id", "features", m=6, minority=1)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in dz.collect():
        nn = np.lexsort((np.arange(len(x)), d[r.id]))[:6]
        n_maj = int((lab[nn] == 0).sum())
        assert r.n_majority == n_maj
        assert r.in_danger == (3 <= n_maj < 6)
    ad = NB.adasyn_counts(df, "Class", "id", "features", k=5, minority=1).collect()
    assert all(r.n_generate >= 0 for r in ad)
    assert abs(sum(r.n_generate for r in ad) - ((lab == 0).sum() - (lab == 1).sum())) <= len(ad)


def test_sampling_info(spark):
    df, _, _ = _points(spark)
    out = NB.smote(df, "Class", "id", "features", k=3)
    info = {r.Class: (r.n_before, r.n_after, r.added) for r in S.sampling_info(df, out, "Class", "SMOTE").collect()}
    assert info[1][1] == info[0][1] and info[0][2] == 0


def test_knn_running_topk_across_many_batches(spark):
    """Many Arrow batches per task: the per-task running top-k must stay exact."""
    df, x, lab = _points(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = NB.knn(df, df.coalesce(1), 5, "id", "features", carry=["Class"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    ids = np.arange(len(x))
    by_q = {}
    for r in got:
        by_q.setdefault(r.q_id, []).append((r["rank"], r.nn_id, r.Class))
    for q in range(len(x)):
        want = ids[np.lexsort((ids, d[q]))[:5]]
        have = sorted(by_q[q])
        assert [h[1] for h in have] == want.tolist()
        assert [h[2] for h in have] == lab[want].tolist()


def test_knn_slices_and_empty_sides_give_the_same_rows(spark):
    import numpy as np

    from calibra.operators.neighbors import knn

    x = np.random.default_rng(3).normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    want = sorted(map(tuple, knn(df, df, 3).collect()))
    assert len(want) == 360
    for bound in (100, 60):
        assert sorted(map(tuple, knn(df, df, 3, max_shipped_values=bound).collect())) == want
    assert knn(df.limit(0), df, 3).count() == 0
    assert knn(df, df.limit(0), 3).count() == 0


def test_smote_strategies_and_too_few_rows(spark):
    import pytest

    from calibra.operators.neighbors import class_targets, smote

    counts = {"a": 3, "b": 7, "c": 10}
    assert class_targets(counts) == {"a": 7, "b": 3} == class_targets(counts, "all")
    assert class_targets(counts, "minority") == {"a": 7}
    assert class_targets(counts, "not minority") == {"b": 3}
    rows = [(i, "abc"[(i > 2) + (i > 9)], [float(i), float(i * i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, y string, features array<double>")
    out = smote(df, "y", "id", "features", k=2)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 10, "b": 10, "c": 10}
    with pytest.raises(ValueError, match="neighbours"):
        smote(df, "y", "id", "features", k=5)
