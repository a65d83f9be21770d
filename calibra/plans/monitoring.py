"""Queries for drift, degradation, alerts, decisions and dashboard tables (D*, B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.functions.frames import join_single_rows
from calibra.operators import compare as C
from calibra.operators import drift as D
from calibra.operators import metrics as M
from calibra.operators import monitor as MON
from calibra.plans.comparison import _MM_SQL
from calibra.plans.evaluation import _COUNTS_SQL, _METRICS_SQL, _div
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V

# Baselines of the reference's monitoring examples.
BASELINE_F1 = 0.85
BASELINE = {"f1_score": 0.85, "precision": 0.80, "recall": 0.90}
LATENCY_THRESHOLD_MS = 300.0

_KS_BODY = """
, lv AS (UNPIVOT (SELECT side, """ + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in V.TX_FEATURES) + """ FROM tx)
         ON """ + ", ".join(V.TX_FEATURES) + """ INTO NAME feature VALUE value),
  lvv AS (SELECT * FROM lv WHERE value IS NOT NULL AND NOT isnan(value)),
  cnt AS (SELECT feature, value, count_if(side = 'reference') AS ca, count_if(side = 'current') AS cb
          FROM lvv GROUP BY feature, value),
  cum AS (SELECT feature, value,
                 sum(ca) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum_ca,
                 sum(cb) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum_cb,
                 sum(ca) OVER (PARTITION BY feature) AS tot_ca, sum(cb) OVER (PARTITION BY feature) AS tot_cb
          FROM cnt),
  per AS (SELECT feature, max(abs(""" + _div("cum_ca", "tot_ca") + " - " + _div("cum_cb", "tot_cb") + """)) AS ks_statistic,
                 CAST(max(tot_ca) AS BIGINT) AS n_reference, CAST(max(tot_cb) AS BIGINT) AS n_current
          FROM cum GROUP BY feature),
  lam AS (SELECT *, ks_statistic * sqrt(CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current)) AS lam
          FROM per),
  pv AS (SELECT feature, ks_statistic, n_reference, n_current,
                CASE WHEN n_reference > 0 AND n_current > 0 THEN greatest(0.0, least(1.0,
                  CASE WHEN lam <= 0 THEN 1.0
                       WHEN lam < 1.0 THEN 1.0 - sqrt(2.0 * pi()) / lam *
                            (SELECT sum(exp(-((2 * k - 1) * (2 * k - 1)) * (pi() * pi()) / (8.0 * lam * lam)))
                             FROM range(1, 9) t(k))
                       ELSE 2.0 * (SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))
                                   FROM range(1, 101) t(k)) END)) END AS p_value
         FROM lam),
  ks AS (SELECT feature, ks_statistic, p_value, coalesce(p_value < 0.05, false) AS drift_detected,
                n_reference, n_current FROM pv)
"""
_KS_SQL = with_views("tx") + _KS_BODY


def _ks(spark, sf_dir):
    return D.ks_two_sample(V.tx(spark, sf_dir), V.TX_FEATURES)


@query("ks_drift", sql=_KS_SQL + "SELECT * FROM ks", rounded="ks_statistic p_value")
def ks_drift(spark, sf_dir):
    """Two-sample KS per feature, reference period vs current period."""
    return _ks(spark, sf_dir)


_DRIFT_SUM_SQL = """
, ds AS (SELECT count(*) AS total_features_checked, count_if(drift_detected) AS features_with_drift,
                coalesce(count_if(drift_detected) * 100.0 / NULLIF(count(*), 0), 0.0) AS drift_percentage,
                count_if(drift_detected) > 0 AS drift_detected FROM ks)
"""


@query("drift_summary", sql=_KS_SQL + _DRIFT_SUM_SQL + "SELECT * FROM ds", rounded="drift_percentage")
def drift_summary(spark, sf_dir):
    """D3: drifted features and percentage of tested features."""
    return D.drift_summary(_ks(spark, sf_dir))


@query("drift_histogram",
       sql=with_views("tx") + """
, lv AS (UNPIVOT (SELECT side, """ + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in V.TX_FEATURES) + """ FROM tx)
         ON """ + ", ".join(V.TX_FEATURES) + """ INTO NAME feature VALUE value),
  lvv AS (SELECT * FROM lv WHERE value IS NOT NULL AND NOT isnan(value)),
  rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lvv GROUP BY feature),
  b AS (SELECT lvv.feature, side, lo, hi,
               CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 30.0)), 29) ELSE 0 END AS INTEGER)
                 AS bin
        FROM lvv JOIN rng ON lvv.feature = rng.feature)
SELECT feature, side, bin, count(*) AS count, first(lo) + bin * (first(hi) - first(lo)) / 30 AS bin_start
FROM b GROUP BY feature, side, bin""",
       rounded="bin_start")
def drift_histogram(spark, sf_dir):
    """30-bin histograms per feature and side on a shared range."""
    return D.histogram(V.tx(spark, sf_dir), V.TX_FEATURES)


_YEAR_SQL = with_views("preds") + f"""
, yc AS (SELECT strftime(day, '%Y') AS period, {_COUNTS_SQL}
         FROM (SELECT day, y_true, pred_a AS y_pred FROM preds) GROUP BY 1),
  ym AS (SELECT period, tp, fp, fn, tn, n, {_METRICS_SQL} FROM yc)
"""


def _yearly(spark, sf_dir, model="a"):
    p = V.preds(spark, sf_dir)
    return MON.windowed_metrics(p, F.date_format("day", "yyyy"), "y_true", f"pred_{model}")


@query("f1_degradation",
       sql=_YEAR_SQL + f"""
SELECT period, f1, {BASELINE_F1} AS baseline_f1, {BASELINE_F1} - f1 AS f1_drop,
       ({BASELINE_F1} - f1) / {BASELINE_F1} * 100.0 AS degradation_percentage,
       ({BASELINE_F1} - f1) > 0.05 AS performance_degraded
FROM ym""",
       rounded="f1 baseline_f1 f1_drop degradation_percentage")
def f1_degradation(spark, sf_dir):
    """Yearly F1 of model a against the 0.85 baseline."""
    ym = _yearly(spark, sf_dir).select("period", "f1")
    return D.f1_degradation(ym, BASELINE_F1)


@query("metric_degradation",
       sql=with_views("preds") + f"""
, c AS (SELECT {_COUNTS_SQL} FROM (SELECT y_true, pred_a AS y_pred FROM preds)),
  m AS (SELECT {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
               {_div('2 * tp', '2 * tp + fp + fn')} AS f1_score FROM c),
  l AS (UNPIVOT m ON f1_score, precision, recall INTO NAME metric VALUE current_value),
  b AS (SELECT * FROM (VALUES ('f1_score', 0.85), ('precision', 0.80), ('recall', 0.90)) t(metric, baseline_value))
SELECT l.metric, CAST(baseline_value AS DOUBLE) AS baseline_value, current_value,
       baseline_value - current_value AS drop, baseline_value - current_value > 0.05 AS degraded
FROM l JOIN b ON l.metric = b.metric""",
       rounded="baseline_value current_value drop")
def metric_degradation(spark, sf_dir):
    """Every baseline metric vs the current value of model a."""
    cur = M.binary_metrics(V.preds(spark, sf_dir), "y_true", "pred_a").withColumnRenamed("f1", "f1_score")
    return D.metric_degradation(cur, BASELINE)


_MONTH_C_SQL = with_views("preds") + f"""
, mc AS (SELECT strftime(day, '%Y-%m') AS period, {_COUNTS_SQL}
         FROM (SELECT day, y_true, pred_c AS y_pred FROM preds) GROUP BY 1),
  mm AS (SELECT period, {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM mc)
"""


def _monthly_c(spark, sf_dir):
    p = V.preds(spark, sf_dir)
    return MON.windowed_metrics(p, F.date_format("day", "yyyy-MM"), "y_true", "pred_c")


@query("performance_alerts",
       sql=_MONTH_C_SQL + """
SELECT period, f1, 'PERFORMANCE_ALERT' AS type, printf('F1 score %.4f below threshold %.2f', f1, 0.8) AS message
FROM mm WHERE f1 < 0.8""",
       rounded="f1")
def performance_alerts(spark, sf_dir):
    """Monthly F1 of model c below 0.8."""
    return MON.performance_alerts(_monthly_c(spark, sf_dir))


@query("monitor_status",
       sql=_MONTH_C_SQL + """
SELECT CASE WHEN count(*) > 0 THEN 'ACTIVE' ELSE 'NO_DATA' END AS status, arg_max(f1, period) AS latest_f1,
       count_if(f1 < 0.8) AS total_alerts, max(period) AS last_update, count(*) AS windows
FROM mm""",
       rounded="latest_f1")
def monitor_status(spark, sf_dir):
    """Status row of the monthly monitor."""
    return MON.monitor_status(_monthly_c(spark, sf_dir))


@query("latency_alerts",
       sql=with_views("log") + f"""
SELECT request_id, ts, 'RESPONSE_TIME_ALERT' AS type,
       printf('Response time %.2fms exceeds threshold %.0fms', processing_time_ms, {LATENCY_THRESHOLD_MS}) AS message
FROM log WHERE processing_time_ms > {LATENCY_THRESHOLD_MS}""")
def latency_alerts(spark, sf_dir):
    """Requests slower than 300 ms."""
    return MON.latency_alerts(V.log(spark, sf_dir), LATENCY_THRESHOLD_MS)


_OVERALL_A_BODY = f"""
, oc AS (SELECT {_COUNTS_SQL} FROM (SELECT y_true, pred_a AS y_pred FROM preds)),
  om AS (SELECT {_div('2 * tp', '2 * tp + fp + fn')} AS current_f1 FROM oc)
"""


def _overall_a(spark, sf_dir):
    return M.binary_metrics(V.preds(spark, sf_dir), "y_true", "pred_a").select(F.col("f1").alias("current_f1"))


def _monitor_row(spark, sf_dir):
    """drift summary + overall degradation of model a, one row (both sides are 1-row aggregates)."""
    ds = D.drift_summary(_ks(spark, sf_dir))
    cur = _overall_a(spark, sf_dir)
    return join_single_rows(ds, cur)


@query("recommendations",
       sql=with_views("tx", "preds") + _KS_BODY + _OVERALL_A_BODY + _DRIFT_SUM_SQL + f"""
SELECT drift_detected, {BASELINE_F1} - current_f1 > 0.05 AS performance_degraded, current_f1,
       CASE WHEN len(list_filter([CASE WHEN drift_detected THEN '{MON.REC_DRIFT}' END,
                                  CASE WHEN {BASELINE_F1} - current_f1 > 0.05 THEN '{MON.REC_DEGRADED}' END],
                                 lambda x: x IS NOT NULL)) > 0
            THEN list_filter([CASE WHEN drift_detected THEN '{MON.REC_DRIFT}' END,
                              CASE WHEN {BASELINE_F1} - current_f1 > 0.05 THEN '{MON.REC_DEGRADED}' END],
                             lambda x: x IS NOT NULL)
            ELSE ['{MON.REC_OK}'] END AS recommendations
FROM ds, om""",
       rounded="current_f1")
def recommendations(spark, sf_dir):
    """Monitoring recommendations from drift and degradation."""
    r = _monitor_row(spark, sf_dir)
    degraded = (F.lit(BASELINE_F1) - F.col("current_f1")) > 0.05
    return r.select("drift_detected", degraded.alias("performance_degraded"), "current_f1",
                    MON.recommendations(F.col("drift_detected"), degraded).alias("recommendations"))


_RETRAIN_SQL = with_views("tx", "preds") + _KS_BODY + _OVERALL_A_BODY + _DRIFT_SUM_SQL + f"""
, span AS (SELECT datediff('day', min(day), max(day)) AS days_since_training FROM preds),
  x AS (SELECT drift_detected, drift_percentage / 100.0 AS drift_fraction,
               {BASELINE_F1} - current_f1 > 0.05 AS degraded,
               ({BASELINE_F1} - current_f1) / {BASELINE_F1} AS degradation_fraction, days_since_training
        FROM ds, om, span),
  r AS (SELECT *, list_filter([
          CASE WHEN drift_detected AND drift_fraction >= 0.1
               THEN printf('{MON.REASON_DRIFT.replace('%%', '%%')}', drift_fraction * 100.0) END,
          CASE WHEN degraded AND abs(degradation_fraction) >= 0.05
               THEN printf('{MON.REASON_PERF}', abs(degradation_fraction) * 100.0) END,
          CASE WHEN days_since_training > 30 THEN printf('{MON.REASON_TIME}', 30) END], lambda x: x IS NOT NULL) AS reasons
        FROM x)
SELECT drift_fraction, degradation_fraction, days_since_training, len(reasons) > 0 AS should_retrain,
       reasons AS retraining_reasons, days_since_training > 30 AS time_based_trigger
FROM r"""


@query("retraining_decision",
       sql=_RETRAIN_SQL,
       rounded="drift_fraction degradation_fraction")
def retraining_decision(spark, sf_dir):
    """Retrain decision with reasons (fractions; time trigger over the scored period)."""
    r = _monitor_row(spark, sf_dir)
    span = V.preds(spark, sf_dir).agg(F.datediff(F.max("day"), F.min("day")).alias("days_since_training"))
    x = join_single_rows(r, span).select(
        "drift_detected", (F.col("drift_percentage") / 100.0).alias("drift_fraction"),
        ((F.lit(BASELINE_F1) - F.col("current_f1")) > 0.05).alias("degraded"),
        ((F.lit(BASELINE_F1) - F.col("current_f1")) / F.lit(BASELINE_F1)).alias("degradation_fraction"),
        "days_since_training")
    cols = MON.retraining_decision(F.col("drift_detected"), F.col("drift_fraction"), F.col("degraded"),
                                   F.col("degradation_fraction"), F.col("days_since_training"))
    return x.select("drift_fraction", "degradation_fraction", "days_since_training", *cols)


@query("service_metrics",
       sql=with_views("log") + """
SELECT event_type, count(*) AS total_requests, count_if(prediction = 0) AS successful_requests,
       """ + _div("count_if(prediction = 0)", "count(*)") + """ AS success_rate,
       avg(processing_time_ms) AS avg_response_time_ms
FROM log GROUP BY event_type""",
       rounded="success_rate avg_response_time_ms")
def service_metrics(spark, sf_dir):
    """Request counters per endpoint (event type); errors are failures."""
    lg = V.log(spark, sf_dir)
    return MON.service_metrics(lg, ["event_type"], error=F.col("prediction") == 1)


@query("rolling_latency",
       sql=with_views("log") + """
SELECT event_type, ts, request_id, processing_time_ms,
       sum(CAST(round(processing_time_ms * 100) AS BIGINT)) OVER w / (count(*) OVER w * 100.0) AS rolling_avg_ms
FROM log
WINDOW w AS (PARTITION BY event_type ORDER BY ts, request_id
             ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
       rounded="processing_time_ms", exact="rolling_avg_ms")
def rolling_latency(spark, sf_dir):
    """Mean of the last 100 response times per endpoint, across midnight too."""
    return MON.rolling_latency(V.log(spark, sf_dir), ["event_type"], ["ts", "request_id"], scale=100)


@query("daily_predictions",
       sql=with_views("log") + """
SELECT CAST(ts AS DATE) AS day, count(*) AS predictions, CAST(sum(prediction) AS BIGINT) AS positives
FROM log GROUP BY 1""")
def daily_predictions(spark, sf_dir):
    """B2: predictions per day."""
    return MON.daily_predictions(V.log(spark, sf_dir))


@query("risk_histogram",
       sql=with_views("log") + """
SELECT CAST(least(floor(score * 100.0 / 2.0), 49) AS INTEGER) AS bin, count(*) AS count FROM log GROUP BY 1""")
def risk_histogram(spark, sf_dir):
    """50-bin risk-score histogram."""
    return MON.risk_histogram(V.log(spark, sf_dir))


@query("time_histogram",
       sql=with_views("log") + """
, r AS (SELECT min(processing_time_ms) AS lo, (max(processing_time_ms) - min(processing_time_ms)) / 30 AS width FROM log),
  b AS (SELECT CAST(least(floor((processing_time_ms - lo) / width), 29) AS INTEGER) AS bin, lo, width FROM log, r)
SELECT bin, lo + bin * width AS lower, lo + (bin + 1) * width AS upper, count(*) AS count FROM b GROUP BY bin, lo, width""",
       rounded="lower upper")
def time_histogram(spark, sf_dir):
    """30-bin histogram of processing times."""
    return MON.time_histogram(V.log(spark, sf_dir))


@query("confidence_counts",
       sql=with_views("log") + """
SELECT CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'medium' ELSE 'high' END AS confidence,
       count(*) AS count
FROM log GROUP BY 1""")
def confidence_counts(spark, sf_dir):
    """Requests per confidence band."""
    return MON.confidence_counts(V.log(spark, sf_dir))


@query("metric_series",
       sql=with_views("preds") + f"""
, c AS (SELECT day, {_COUNTS_SQL} FROM (SELECT day, y_true, pred_a AS y_pred FROM preds) GROUP BY day)
SELECT day, tp, fp, fn, tn, n, {_METRICS_SQL} FROM c""",
       rounded="accuracy precision recall f1")
def metric_series(spark, sf_dir):
    """B1: daily F1 / precision / recall series of model a."""
    return M.binary_metrics(V.preds(spark, sf_dir), "y_true", "pred_a", ["day"])


@query("model_metrics_long",
       sql=_MM_SQL + """
UNPIVOT (SELECT model, accuracy, precision, recall, f1_score, roc_auc, avg_precision FROM mm)
ON accuracy, precision, recall, f1_score, roc_auc, avg_precision INTO NAME metric VALUE value""",
       rounded="value")
def model_metrics_long(spark, sf_dir):
    """Long (model, metric, value) table for comparison bars."""
    mm = C.model_metrics(V.preds_long(spark, sf_dir))
    return mm.unpivot(["model"], C.RANK_METRICS, "metric", "value")


@query("cli_retrain_rule",
       sql=with_views("tx", "preds") + _KS_BODY + _OVERALL_A_BODY + _DRIFT_SUM_SQL + f"""
SELECT current_f1, {BASELINE_F1} AS baseline_f1, current_f1 < {BASELINE_F1} AS performance_degraded,
       current_f1 < {BASELINE_F1} OR drift_detected AS should_retrain,
       CASE WHEN current_f1 < {BASELINE_F1} OR drift_detected THEN 'RETRAIN' ELSE 'NO ACTION' END AS action
FROM ds, om""",
       rounded="current_f1 baseline_f1")
def cli_retrain_rule(spark, sf_dir):
    """Retrain when F1 is below the baseline or any feature drifted."""
    r = _monitor_row(spark, sf_dir)
    return r.select("current_f1", F.lit(BASELINE_F1).alias("baseline_f1"),
                    *MON.cli_retrain_rule(F.col("current_f1"), F.lit(BASELINE_F1), F.col("drift_detected")))


@query("retraining_notifications",
       sql=f"""
SELECT should_retrain AS triggered,
       CASE WHEN should_retrain THEN '{MON.NOTE_TRIGGERED[0]}' ELSE '{MON.NOTE_STABLE[0]}' END AS type,
       CASE WHEN should_retrain THEN '{MON.NOTE_TRIGGERED[1]}' ELSE '{MON.NOTE_STABLE[1]}' END AS message,
       CASE WHEN should_retrain THEN retraining_reasons ELSE []::VARCHAR[] END AS reasons,
       ['log'] AS channels
FROM ({_RETRAIN_SQL}) AS d""")
def retraining_notifications(spark, sf_dir):
    """Trigger / notification record for the current retraining decision."""
    return MON.notification_rows(retraining_decision(spark, sf_dir), ("log",))
