"""Drift, degradation, alerts and decisions: goldens from the reference demos."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions.columns import chi2_1_sf, kolmogorov_sf, norm_two_sided_p
from calibra.operators import drift as D
from calibra.operators import metrics as M
from calibra.operators import monitor as MON


def _ks_numpy(a, b):
    v = np.sort(np.unique(np.concatenate([a, b])))
    fa = np.searchsorted(np.sort(a), v, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), v, side="right") / len(b)
    return np.abs(fa - fb).max()


def _kolmogorov_sf(lam):
    if lam <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def test_ks_two_sample_matches_numpy(spark):
    rng = np.random.default_rng(42)
    ref = np.round(rng.normal(100, 50, 1000), 1)
    cur = np.round(rng.normal(120, 50, 500), 1)
    ref[3] = np.nan
    rows = [("reference", float(v)) for v in ref] + [("current", float(v)) for v in cur]
    df = spark.createDataFrame(rows, "side string, amount double")
    r = D.ks_two_sample(df, ["amount"], buckets=7).first()
    a = ref[~np.isnan(ref)]
    d = _ks_numpy(a, cur)
    assert r.ks_statistic == pytest.approx(d, abs=1e-12)
    assert (r.n_reference, r.n_current) == (999, 500)
    lam = d * math.sqrt(999 * 500 / 1499)
    assert r.p_value == pytest.approx(_kolmogorov_sf(lam), abs=1e-9)
    assert r.drift_detected


def test_kolmogorov_small_lambda_branch(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.9,), (1.2,)], "lam double")
    got = [r.p for r in df.select(kolmogorov_sf(F.col("lam")).alias("p")).collect()]
    # both series agree where they overlap; the small-lambda one near 1
    assert got[0] == pytest.approx(0.99999, abs=1e-4)
    assert got[3] == pytest.approx(_kolmogorov_sf(1.2), abs=1e-9)
    assert got[2] == pytest.approx(_kolmogorov_sf(0.9), abs=1e-6)


def test_normal_and_chi2_tails(spark):
    df = spark.createDataFrame([(1.959963984540054, 3.841458820694124)], "z double, s double")
    r = df.select(norm_two_sided_p(F.col("z")).alias("p"), chi2_1_sf(F.col("s")).alias("q")).first()
    assert r.p == pytest.approx(0.05, abs=2e-7)
    assert r.q == pytest.approx(0.05, abs=2e-7)


def test_degradation_goldens(spark):
    # Golden input and its expected results.
    y_true = [0, 0, 1, 0, 1, 0, 0, 1, 0, 0]
    y_pred = [0, 0, 1, 0, 0, 1, 0, 1, 0, 0]
    df = spark.createDataFrame(list(zip(y_true, y_pred)), "y_true int, y_pred int")
    cur = M.binary_metrics(df).withColumnRenamed("f1", "f1_score")
    got = {r.metric: (r.drop, r.degraded) for r in
           D.metric_degradation(cur, {"f1_score": 0.85, "precision": 0.80, "recall": 0.90}).collect()}
    assert got["f1_score"][0] == pytest.approx(0.183333, abs=1e-6)
    assert got["precision"][0] == pytest.approx(0.133333, abs=1e-6)
    assert got["recall"][0] == pytest.approx(0.233333, abs=1e-6)
    assert all(v[1] for v in got.values())
    alerts = MON.performance_alerts(cur.withColumn("period", F.lit("now")).withColumnRenamed("f1_score", "f1"))
    assert alerts.count() == 1


def test_f1_degradation_not_degraded_at_003(spark):
    cur = spark.createDataFrame([(0.82,)], "f1 double")
    r = D.f1_degradation(cur, 0.85).first()
    assert r.f1_drop == pytest.approx(0.03) and not r.performance_degraded


def test_recommendations_and_retraining(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, False)], "drift boolean, deg boolean")
    recs = [r.r for r in df.select(MON.recommendations(F.col("drift"), F.col("deg")).alias("r")).collect()]
    assert recs[0] == [MON.REC_DRIFT] and recs[1] == [MON.REC_DEGRADED] and recs[2] == [MON.REC_OK]
    d = spark.createDataFrame([(True, 0.25, True, 0.0353, 45)], "dd boolean, df double, dg boolean, gf double, days int")
    r = d.select(*MON.retraining_decision(F.col("dd"), F.col("df"), F.col("dg"), F.col("gf"), F.col("days"))).first()
    assert r.should_retrain and len(r.retraining_reasons) == 2 and r.time_based_trigger
    assert r.retraining_reasons[0] == "Data drift detected in 25.0% of features"


def test_monitor_status_trend(spark):
    wm = spark.createDataFrame([("10:00", 0.85), ("11:00", 0.82), ("12:00", 0.79), ("13:00", 0.76)],
                               "period string, f1 double")
    s = MON.monitor_status(wm).first()
    assert s.status == "ACTIVE" and s.latest_f1 == 0.76 and s.total_alerts == 2


def test_rolling_latency_exact(spark):
    log = spark.createDataFrame([(i, "e", float(i) + 0.01) for i in range(150)], "ts long, ep string, processing_time_ms double")
    r = MON.rolling_latency(log, ["ep"], ["ts"], last=100, scale=100).where("ts = 149").first()
    assert r.rolling_avg_ms == pytest.approx(np.mean(np.arange(50, 150) + 0.01))
