"""Halo windows, early stopping, both arms, registry snapshots, calibrated SVM and block products."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import abtest as AB
from calibra.operators import features as FE
from calibra.operators import models as ML
from calibra.operators import monitor as MON
from calibra.operators import runs as R


@pytest.mark.parametrize(("last", "buckets"), [(1, 8), (5, 1), (5, 7), (100, 40), (7, 500)])
def test_rolling_means_cross_every_border(spark, last, buckets):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1, 20)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t0 + dt.timedelta(minutes=rng.choice([0, i, 3 * i])), i, rng.randint(1, 99) / 100)
            for i in range(300)]
    df = spark.createDataFrame(rows, "e string, ts timestamp, id long, processing_time_ms double").repartition(3)
    got = {r.id: r.rolling_avg_ms for r in MON.rolling_latency(df, ["e"], ["ts", "id"], last=last, scale=100, buckets=buckets).collect()}
    assert len(got) == 300
    for e in ("a", "b", None):
        own = sorted((t, i, v) for x, t, i, v in rows if x == e)
        for at, (_, i, _) in enumerate(own):
            window = [v for _, _, v in own[max(0, at - last + 1):at + 1]]
            assert got[i] == pytest.approx(sum(window) / len(window))


def _requests(spark, n, good):
    rng = random.Random(2)
    rows = [(i, "AB"[i % 2], 1, int(rng.random() < good[i % 2]), 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "k long, arm string, y_true int, y_pred int, score double").repartition(3)


def test_sequential_test_ranks_only_what_it_needs(spark):
    early, late = _requests(spark, 6000, (0.9, 0.5)), _requests(spark, 2000, (0.7, 0.7))
    report = {}
    kept, decision = AB.sequential_result(AB.sequential_batches(early, "k", 20, 50, report=report))
    assert report["table"] == 6000 and report["ranked"] < 3000
    rows, d = kept.orderBy("batch").collect(), decision.first()
    assert d.early_stopped and d.final_decision == "A" and rows[-1].significant and not any(r.significant for r in rows[:-1])
    assert [r.batch for r in rows] == list(range(1, len(rows) + 1)) and all(r.samples == 20 for r in rows)
    done = AB.sequential_result(AB.sequential_batches(late, "k", 30, 900))[0].collect()
    assert len(done) == 67 and min(r.samples for r in done) == 20      # the whole table, with its short last batch
    nothing = AB.sequential_result(AB.sequential_batches(late.limit(0), "k"))[0]
    assert nothing.collect() == []


def test_an_arm_without_requests_has_a_row_of_zeros(spark):
    only = _requests(spark, 40, (1, 1)).where("arm = 'A'")
    arms = {r.arm: r for r in AB.arm_metrics(only).collect()}
    assert arms["A"].sample_size == 20
    assert tuple(arms["B"])[1:] == (0.0, 0.0, 0.0, 0.0, 0.5, 0, 0, 0, 0, 0)
    assert AB.compare_arms(AB.arm_metrics(only)).first().winner == "A"


def test_time_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(61)] + [(None,)], "processing_time_ms double")
    h = {r.bin: r for r in MON.time_histogram(df).collect()}
    assert len(h) == 30 and h[29]["count"] == 3 and h[0].lower == 0 and h[29].upper == 60
    same = MON.time_histogram(df.where("processing_time_ms = 5")).collect()
    assert [(r.bin, r.lower, r.upper, r["count"]) for r in same] == [(0, 5.0, 5.0, 1)]
    assert MON.time_histogram(df.limit(0)).collect() == []


VERSIONS = "name string, version long, run_id long, current_stage string, creation_timestamp timestamp"


def _versions(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("m", 1, 1, "Production", t), ("m", 2, 2, "Production", t), ("m", 3, 3, "None", t),
                                  ("n", 1, 4, "Staging", t)], VERSIONS)


def test_tags_are_set_kept_and_cleared(spark):
    v = R.set_tags(_versions(spark), F.lit(True), {"owner": "x"})
    marked = R.mark_retraining(v, True, ["drift", "age"])
    tags = {(r.name, r.version): r.tags for r in marked.collect()}
    assert tags["m", 2] == {"owner": "x", "retraining_needed": "true", "retraining_reasons": "drift, age"}
    assert all(t == {"owner": "x"} for key, t in tags.items() if key != ("m", 2))
    cleared = {(r.name, r.version): r.tags for r in R.mark_retraining(marked, False).collect()}
    assert all(t == {"owner": "x"} for t in cleared.values())
    assert R.flag_production(marked, True).where("version = 2").first().tags.count("needs_retraining") == 1


def test_two_writers_cannot_lose_an_update(spark, tmp_path):
    reg = R.VersionRegistry(spark, str(tmp_path / "registry"))
    assert reg.latest() == 0
    base = reg.commit(_versions(spark), 0)
    first = R.promote_latest(reg.read(base))
    second = R.set_tags(reg.read(base), F.col("name") == "n", {"owner": "y"})
    assert reg.commit(first, base) == 2
    with pytest.raises(R.RegistryConflict):
        reg.commit(second, base)
    seen = []

    def change(now):
        if not seen:                      # another writer commits while this one works
            seen.append(reg.commit(R.set_tags(now, F.col("name") == "m", {"by": "other"}), reg.latest()))
        return R.set_tags(now, F.col("name") == "n", {"owner": "y"})

    assert reg.update(change) == 4 and reg.latest() == 4
    final = {(r.name, r.version): r for r in reg.read().collect()}
    assert final["m", 3].current_stage == "Staging" and final["m", 3].tags == {"by": "other"}
    assert final["n", 1].tags == {"owner": "y"}
    assert reg.read(1).count() == 4 and not [p for p in (tmp_path / "registry").iterdir() if p.name.startswith("draft")]


def test_block_moments_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 6)) + 1e6
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(5)
    n, mean, cov = FE.block_moments(df, ["v"])
    assert n == 3000 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), rtol=1e-7)
    wide = df.select(*[F.col("v")[i].alias(f"c{i}") for i in range(6)])
    model = FE.CenteredPCA([f"c{i}" for i in range(6)], k=6).fit(wide)
    load, ratio = model._loadings(), np.array(model.getOrDefault("explained"))
    assert np.allclose(load @ load.T, np.eye(6), atol=1e-9) and ratio.sum() == pytest.approx(1)
    scores = np.array([tuple(r) for r in model.transform(wide).collect()])
    assert np.allclose(scores.var(0).sum(), np.trace(cov), rtol=1e-6)
    with pytest.raises(ValueError, match="NaN"):
        FE.CenteredPCA(["c0", "c1"], k=1).fit(wide.withColumn("c1", F.when(F.col("c0") > 1e6, F.col("c1"))))
    with pytest.raises(ValueError):
        FE.CenteredPCA(["c0"], k=1).fit(wide.limit(0))


def test_calibrated_svm_beats_the_plain_sigmoid(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-(3 * x[:, 0] - x[:, 1] - 1)))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))],
                               "id long, a double, b double, y int, fold int").cache()
    model, scale = ML.fit_calibrated_svm(df, ["a", "b"], "y", "fold", weight_col=None, maxIter=30)
    scored = ML.calibrated_scores(model, scale, df, keep=["id", "y"]).toPandas().sort_values("id")
    plain = ML.score(model, df, keep=["id", "y"]).toPandas().sort_values("id")
    brier = {n: ((d.probability - d.y) ** 2).mean() for n, d in (("platt", scored), ("plain", plain))}
    assert brier["platt"] < brier["plain"] - 0.002

    # the two numbers against Newton's method on the same margins and smoothed targets
    m = ML.margins(model, df, ["y"]).toPandas()
    pos, neg = (m.y == 1).sum(), (m.y == 0).sum()
    t = np.where(m.y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, beta = np.stack([m.margin, np.ones(len(m))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (t - p))
    assert ML.fit_platt(ML.margins(model, df, ["y"]), "y") == pytest.approx(tuple(beta), rel=1e-4)
    with pytest.raises(ValueError, match="two folds"):
        ML.fit_calibrated_svm(df.where("fold = 0"), ["a", "b"], "y", "fold", weight_col=None)


def test_random_grid_divides_the_penalty_by_the_rows():
    est = ML.make_estimator("logistic_regression", "y")
    one, many = (ML.random_grid("logistic_regression", est, 5, n=n) for n in (1, 1000))
    assert all(a[est.regParam] == pytest.approx(1000 * b[est.regParam]) for a, b in zip(one, many, strict=True))


def test_feature_split_and_missing_columns(spark, tmp_path):
    from calibra.operators import quality as Q
    from calibra.sources import files

    df = spark.createDataFrame([(1, 2.0, 3.0, 1)], "id long, a double, b double, y int")
    x, y = Q.split_features(df, "y", ["id"], ["b"])
    assert x.columns == ["id", "a"] and y.columns == ["id", "y"]
    with pytest.raises(ValueError, match="Target"):
        Q.split_features(df, "z")
    files.export_csv(df, str(tmp_path / "f"))
    with pytest.raises(files.MissingColumnsError, match="Amount"):
        files.load_csv(spark, str(tmp_path / "f"))


def test_reports_are_partitioned_by_date(spark, tmp_path):
    from calibra.sources import files

    df = spark.createDataFrame([("m", 0.5)], "name string, f1 double")
    for day in ("2024-01-01", "2024-01-02"):
        files.write_report(df, str(tmp_path / "r"), F.lit(day))
    back = spark.read.json(str(tmp_path / "r"))
    assert back.count() == 2 and back.select("run_date").distinct().count() == 2


def test_every_model_type_trains(spark):
    import __spark_entry__ as E

    rows = {r.model: r for r in E.queries()["train_models"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(ML.MODEL_TYPES)
    assert all(r.status == "SUCCESS" and 0 < r.weighted_f1 <= 1 and r.error is None for r in rows.values())
