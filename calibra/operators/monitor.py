"""Monitoring, decisions and dashboard tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.columns import missing, safe_div
from calibra.functions.prefix import with_buckets
from calibra.operators import metrics as M
from calibra.operators.quality import confidence_band

# Alert types and messages.
RESPONSE_TIME_ALERT = "RESPONSE_TIME_ALERT"
PERFORMANCE_ALERT = "PERFORMANCE_ALERT"
MSG_LATENCY = "Response time %.2fms exceeds threshold %.0fms"
MSG_F1 = "F1 score %.4f below threshold %.2f"
# Monitoring recommendations.
REC_DRIFT = "Data drift detected - consider retraining model"
REC_DEGRADED = "Performance degradation detected - investigate and retrain"
REC_OK = "Model is performing well - continue monitoring"
# Retraining reasons.
REASON_DRIFT = "Data drift detected in %.1f%% of features"
REASON_PERF = "Performance degradation of %.1f%% detected"
REASON_TIME = "Time-based retraining trigger (>%d days)"


def latency_alerts(log: DataFrame, threshold_ms: float = 1000.0, ts: str = "ts",
                   latency: str = "processing_time_ms", key: str = "request_id") -> DataFrame:
    """One alert row per request slower than the threshold (stateless filter)."""
    return log.where(F.col(latency) > threshold_ms).select(
        key, ts, F.lit(RESPONSE_TIME_ALERT).alias("type"),
        F.format_string(MSG_LATENCY, F.col(latency), F.lit(float(threshold_ms))).alias("message"))


def windowed_metrics(df: DataFrame, window_col: Column, label: str = "y_true",
                     pred: str = "y_pred") -> DataFrame:
    """E2 per time window (a column such as ``date_trunc('month', ts)``)."""
    return M.binary_metrics(df.withColumn("period", window_col), label, pred, ["period"])


def performance_alerts(wm: DataFrame, f1_threshold: float = 0.8) -> DataFrame:
    """Windows whose F1 is below the threshold."""
    return wm.where(F.col("f1") < f1_threshold).select(
        "period", "f1", F.lit(PERFORMANCE_ALERT).alias("type"),
        F.format_string(MSG_F1, F.col("f1"), F.lit(float(f1_threshold))).alias("message"))


def monitor_status(wm: DataFrame, f1_threshold: float = 0.8) -> DataFrame:
    """ACTIVE/NO_DATA, latest F1, number of alerts, last update."""
    return wm.agg(
        F.when(F.count(F.lit(1)) > 0, "ACTIVE").otherwise("NO_DATA").alias("status"),
        F.max_by("f1", "period").alias("latest_f1"),
        F.count_if(F.col("f1") < f1_threshold).alias("total_alerts"),
        F.max("period").alias("last_update"),
        F.count(F.lit(1)).alias("windows"))


def recommendations(drift_detected: Column, degraded: Column) -> Column:
    """Recommendation messages from the two flags."""
    recs = F.array_compact(F.array(F.when(drift_detected, F.lit(REC_DRIFT)),
                                   F.when(degraded, F.lit(REC_DEGRADED))))
    return F.when(F.size(recs) > 0, recs).otherwise(F.array(F.lit(REC_OK)))


def retraining_decision(drift_detected: Column, drift_fraction: Column, degraded: Column,
                        degradation_fraction: Column, days_since_training: Column | None = None,
                        drift_threshold: float = 0.1, perf_threshold: float = 0.05,
                        max_days: int = 30) -> list[Column]:
    """Reasons and decision.  Thresholds and inputs are fractions (0-1);
    the time trigger fires when ``days_since_training > max_days``."""
    time_trigger = (days_since_training > max_days) if days_since_training is not None else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(drift_detected & (drift_fraction >= drift_threshold),
               F.format_string(REASON_DRIFT, drift_fraction * 100.0)),
        F.when(degraded & (F.abs(degradation_fraction) >= perf_threshold),
               F.format_string(REASON_PERF, F.abs(degradation_fraction) * 100.0)),
        F.when(time_trigger, F.format_string(REASON_TIME, F.lit(max_days)))))
    return [(F.size(reasons) > 0).alias("should_retrain"), reasons.alias("retraining_reasons"),
            time_trigger.alias("time_based_trigger")]


def service_metrics(log: DataFrame, by: Sequence[str] = (), error: Column | None = None,
                    latency: str = "processing_time_ms") -> DataFrame:
    """Total requests, successes, success rate, mean latency."""
    err = error if error is not None else F.lit(False)
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~err).alias("successful_requests"),
        safe_div(F.count_if(~err), F.count(F.lit(1))).alias("success_rate"),
        F.avg(latency).alias("avg_response_time_ms"))


def rolling_latency(log: DataFrame, partition: Sequence[str], order: Sequence[str],
                    latency: str = "processing_time_ms", last: int = 100,
                    scale: int | None = None, buckets: int | None = None) -> DataFrame:
    """Mean of the last ``last`` response times of its endpoint at every request.

    A rows-frame window per endpoint would put a hot endpoint in one task.  Instead an
    endpoint's requests are cut into time buckets of about equal size, and every bucket
    gets a halo: the ``last - 1`` requests before it, copied across its border (from
    several buckets where those in between hold few).  The window then runs inside each bucket.  Halos come
    from the last requests of every bucket, found by a partial group limit, and from
    the buckets' counts.

    With ``scale`` (e.g. 100 for values recorded to 0.01 ms) the sums run on
    exact integers, so the mean does not depend on the summation order.
    ``order`` starts with the timestamp column; the rest break ties.
    """
    ts, keys = order[0], list(partition)
    units = (F.round(F.col(latency) * scale).cast("bigint") if scale is not None
             else F.col(latency).cast("double"))
    tt = log.schema[ts].dataType.typeName()
    tnum = F.unix_micros(F.col(ts).cast("timestamp")) if tt.startswith("timestamp") else F.col(ts)
    base = with_buckets(log.select(*keys, *order, latency, tnum.alias("_t"), units.alias("_u")), keys, "_t", buckets)
    in_bucket = Window.partitionBy(*keys, "_bucket")
    # per bucket: requests before it, and for the buckets behind it the same, as many as a halo may reach
    counts = base.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_bucket")
    sized = counts.withColumn("_before", F.sum("_n").over(line) - F.col("_n"))
    behind = sized.withColumn("_behind", F.collect_list(F.struct("_bucket", "_before")).over(line.rowsBetween(1, max(1, last - 1))))
    tails = base.withColumn("_r", F.row_number().over(in_bucket.orderBy(*[F.col(c).desc() for c in order]))).where(
        F.col("_r") < last)
    same = [tails[c].eqNullSafe(behind[c]) for c in [*keys, "_bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    placed = tails.join(behind.drop("_n", "_before"), on).where(F.size("_behind") > 0).select(
        *[tails[c] for c in base.columns], "_behind", "_r", F.col("_behind")[0]["_before"].alias("_end"))
    # a request of overall place g is in the halo of every bucket that begins less than ``last`` places on
    place = F.col("_end") - F.col("_r") + 1
    halo = placed.withColumn(
        "_to", F.explode(F.filter("_behind", lambda b: b["_before"] < place + last - 1))) \
        .select(*[F.col("_to._bucket").alias(c) if c == "_bucket" else F.col(c) for c in base.columns], F.lit(True).alias("_halo"))
    both = base.withColumn("_halo", F.lit(False)).unionByName(halo)
    frame = in_bucket.orderBy(*order).rowsBetween(-(last - 1), Window.currentRow)
    avg = F.sum("_u").over(frame) / (F.count(F.lit(1)).over(frame) * float(scale if scale is not None else 1))
    return both.withColumn("rolling_avg_ms", avg).where(~F.col("_halo")).select(*keys, *order, latency, "rolling_avg_ms")


def daily_predictions(log: DataFrame, ts: str = "ts", pred: str = "prediction") -> DataFrame:
    """B2: predictions and positives per day."""
    return log.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("predictions"), F.sum(pred).cast("bigint").alias("positives"))


def risk_histogram(log: DataFrame, prob: str = "score", bins: int = 50) -> DataFrame:
    """Histogram of risk score (0-100) with ``bins`` equal bins."""
    risk = F.col(prob) * 100.0
    b = F.least(F.floor(risk / (100.0 / bins)), F.lit(bins - 1)).cast("int")
    return log.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def time_histogram(log: DataFrame, latency: str = "processing_time_ms", bins: int = 30) -> DataFrame:
    """Histogram of processing times with ``bins`` equal bins from the least to the greatest:
    ``bin, lower, upper, count``.  Missing values are left out; one value fills bin 0 of width 0."""
    v = F.col(latency)
    kept = log.where(~missing(latency))
    low, high = kept.agg(F.min(v), F.max(v)).first()
    if low is None:
        return kept.groupBy(F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper")).agg(
            F.count(F.lit(1)).alias("count"))
    width = (high - low) / bins
    b = F.least(F.floor(F.try_divide(v - low, F.lit(width))), F.lit(bins - 1)) if width else F.lit(0)
    return kept.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")).select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"), "count")


def confidence_counts(log: DataFrame, prob: str = "score", closed: str = "left") -> DataFrame:
    """Counts per confidence band."""
    return log.groupBy(confidence_band(prob, closed=closed).alias("confidence")).agg(
        F.count(F.lit(1)).alias("count"))


# Notification types and messages.
NOTE_TRIGGERED = ("retraining_triggered", "Automated retraining triggered")
NOTE_STABLE = ("retraining_not_needed", "Model performance stable - no retraining needed")


def cli_retrain_rule(current_f1: Column, baseline_f1: Column, drift_detected: Column) -> list[Column]:
    """The command-line rule - retrain when F1 fell below the baseline or drift was seen."""
    return [(current_f1 < baseline_f1).alias("performance_degraded"),
            ((current_f1 < baseline_f1) | drift_detected).alias("should_retrain"),
            F.when((current_f1 < baseline_f1) | drift_detected, "RETRAIN").otherwise("NO ACTION").alias("action")]


def notification_rows(decision: DataFrame, channels: tuple[str, ...] = ("log",)) -> DataFrame:
    """One trigger/notification record per decision row (sending is not done here)."""
    go = F.col("should_retrain")
    return decision.select(
        go.alias("triggered"),
        F.when(go, F.lit(NOTE_TRIGGERED[0])).otherwise(F.lit(NOTE_STABLE[0])).alias("type"),
        F.when(go, F.lit(NOTE_TRIGGERED[1])).otherwise(F.lit(NOTE_STABLE[1])).alias("message"),
        F.when(go, F.col("retraining_reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.array(*[F.lit(c) for c in channels]).alias("channels"))
