"""Streaming queries (T1-T9): each reads a test table as a file stream and returns the
sink; the oracle is batch SQL.

Windows, sessions and the outer join run in append mode over several deliveries of the
table (time slices, some rows held back until the next one), so their state lives on
between runs, the watermark closes it, and late rows are counted.  A last delivery of one
marker row far in the future moves the watermark past all real data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.operators import abtest as AB
from calibra.plans.comparison import norm_p_sql
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V
from calibra.sources.streams import run_available, run_deliveries, slices, table_stream
from calibra.sources.tables import table
from calibra.streaming import monitors as S

_FMT = "'%Y-%m-%d %H:%M:%S'"


def _log_stream(spark, sf_dir):
    return V.log_from(table_stream(spark, sf_dir, "events"))


@query("stream_scored_events",
       sql=with_views("log") + """
SELECT request_id, ts, score AS probability, CAST(score >= 0.5 AS INTEGER) AS decision,
       CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'medium' ELSE 'high' END AS confidence,
       score * 100.0 AS risk_score, processing_time_ms FROM log""",
       rounded="probability risk_score processing_time_ms")
def stream_scored_events(spark, sf_dir):
    """Scored-event stream appended to a parquet sink."""
    return run_available(S.scored_events(_log_stream(spark, sf_dir)), "append", "scored")


@query("stream_latency_alerts",
       sql=with_views("log") + """
SELECT request_id, ts, 'RESPONSE_TIME_ALERT' AS type,
       printf('Response time %.2fms exceeds threshold %.0fms', processing_time_ms, 300.0) AS message
FROM log WHERE processing_time_ms > 300.0""")
def stream_latency_alerts(spark, sf_dir):
    """Stateless latency alert stream."""
    from calibra.operators.monitor import latency_alerts

    return run_available(latency_alerts(_log_stream(spark, sf_dir), 300.0), "append", "latency")


#: deliveries of a table, and which keys are held back until the next one
DELIVERIES, HELD_BACK = 3, 17


def _arrivals(df, ts: str, key: str | None, **marked):
    """The table's time slices as frames in order of arrival, and a marker row that closes everything
    (nulls but for its time and ``marked``; a join key must not be null, or the row is dropped too early)."""
    at, _, high = slices(df, ts, DELIVERIES)
    if key:
        held = (F.col(key) % HELD_BACK == 0) & (at < DELIVERIES - 1)
        at = at + held.cast("int")
    parts = [df.where(at == i) for i in range(DELIVERIES)]
    far = F.timestamp_micros(F.lit((high or 0) + 90 * 86_400_000_000)).cast(df.schema[ts].dataType)
    marker = df.sparkSession.range(1).select(*[
        (far if f.name == ts else F.lit(marked.get(f.name)).cast(f.dataType)).alias(f.name) for f in df.schema])
    return [*parts, marker]


def _arrived_sql(source: str, ts: str, key: str | None) -> str:
    """CTE ``arrived``: rows of ``source`` with the watermark's newest time ``seen`` when they arrive."""
    held = f"CASE WHEN {key} % {HELD_BACK} = 0 AND s < {DELIVERIES - 1} THEN 1 ELSE 0 END" if key else "0"
    return f"""
, lim AS (SELECT min(epoch_us({ts})) AS lo, max(epoch_us({ts})) AS hi FROM {source}),
  cut AS (SELECT {source}.*, least({DELIVERIES - 1}, (epoch_us({ts}) - lo) * {DELIVERIES} // greatest(hi - lo, 1)) AS s
          FROM {source}, lim),
  come AS (SELECT *, s + {held} AS d FROM cut),
  per AS (SELECT d, max({ts}) AS newest FROM come GROUP BY d),
  arrived AS (SELECT come.*, (SELECT max(newest) FROM per WHERE per.d < come.d) AS seen FROM come)"""


@query("stream_daily_counts",
       sql=with_views("log") + _arrived_sql("log", "ts", "request_id") + f"""
SELECT strftime(date_trunc('day', ts), {_FMT}) AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, {_FMT}) AS window_end, event_type,
       count(*) FILTER (NOT late) AS n, CAST(sum(prediction) FILTER (NOT late) AS BIGINT) AS sum_prediction,
       count(*) FILTER (late) AS n_late
FROM (SELECT *, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= seen - INTERVAL 1 HOUR, false) AS late FROM arrived)
GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir):
    """Closed one-day windows per event type (watermark 1 hour), with the rows that came too late."""
    keys = ["window_start", "window_end", "event_type"]

    def count(events):
        return S.windowed_counts(V.log_from(events), "ts", "1 day", by=["event_type"], value="prediction")

    events = table(spark, sf_dir, "events")
    closed = run_deliveries(count, {"events": _arrivals(events, "ts", "event_id")}, "daily")
    return S.late_counts(count(events), closed, keys)


@query("stream_sliding_counts",
       sql=with_views("log") + f"""
, w AS (SELECT date_trunc('day', ts) - t.j * INTERVAL 1 DAY AS ws FROM log, range(0, 7) t(j))
SELECT strftime(ws, {_FMT}) AS window_start, strftime(ws + INTERVAL 7 DAY, {_FMT}) AS window_end, count(*) AS n
FROM w GROUP BY ws""")
def stream_sliding_counts(spark, sf_dir):
    """Closed sliding 7-day windows every day; a window spans deliveries."""
    return run_deliveries(lambda events: S.windowed_counts(V.log_from(events), "ts", "7 days", "1 day"),
                          {"events": _arrivals(table(spark, sf_dir, "events"), "ts", None)}, "sliding")


@query("stream_window_metrics",
       sql=with_views("preds") + """
, o AS (SELECT *, CAST(day AS TIMESTAMP) AS ets FROM preds)""" + _arrived_sql("o", "ets", "o_orderkey") + f"""
, b AS (SELECT *, to_timestamp(floor(epoch(ets) / 2592000) * 2592000)::TIMESTAMP AS ws FROM arrived),
  l AS (SELECT *, coalesce(ws + INTERVAL 30 DAY <= seen - INTERVAL 30 DAY, false) AS late FROM b),
  c AS (SELECT ws, count(*) FILTER (NOT late AND y_true = 1 AND pred_a = 1) AS tp,
               count(*) FILTER (NOT late AND y_true = 0 AND pred_a = 1) AS fp,
               count(*) FILTER (NOT late AND y_true = 1 AND pred_a = 0) AS fn,
               count(*) FILTER (NOT late AND y_true = 0 AND pred_a = 0) AS tn, count(*) FILTER (late) AS n_late
        FROM l GROUP BY ws)
SELECT strftime(ws, {_FMT}) AS window_start, tp, fp, fn, tn,
       coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1,
       coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) < 0.8 AS alert, n_late
FROM c""",
       rounded="f1")
def stream_window_metrics(spark, sf_dir):
    """T4: F1 per closed 30-day event-time window of the order stream, alert flag, late rows."""
    def metrics(orders):
        p = V.preds_from(orders).withColumn("ets", F.col("day").cast("timestamp"))
        return S.windowed_metrics(p, "ets", "30 days", "y_true", "pred_a", "30 days")

    orders = table(spark, sf_dir, "orders")
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    closed = run_deliveries(metrics, {"orders": _arrivals(orders, "o_orderdate", "o_orderkey")}, "winmetrics")
    return S.late_counts(metrics(orders).withColumn("n", total), closed.withColumn("n", total), ["window_start"]).drop("n")


@query("stream_sessions",
       sql=with_views("log") + f"""
, g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, request_id) IS NULL
                                   OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, request_id)
                                      >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM log),
  s AS (SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
        FROM g)
SELECT user_id, strftime(min(ts), {_FMT}) AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, {_FMT}) AS session_end, count(*) AS events
FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, sf_dir):
    """T5: closed per-user sessions with a 30-minute gap; sessions span deliveries."""
    return run_deliveries(lambda events: S.sessions(V.log_from(events), "user_id", "ts"),
                          {"events": _arrivals(table(spark, sf_dir, "events"), "ts", None)}, "sessions")


def _labels_from(events, delay: int = 1):
    """Labels of the scored requests: a purchase confirms fraud; they arrive ``delay`` x k minutes later."""
    k = F.get_json_object("props", "$.k").cast("int") * delay
    return events.select(F.col("event_id").alias("request_id"),
                         (F.col("event_type") == "purchase").cast("int").alias("label"),
                         (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=k)).alias("label_ts"))


@query("stream_late_labels",
       sql=with_views("log") + f"""
, lab AS (SELECT event_id AS rid, CAST(event_type = 'purchase' AS INTEGER) AS label,
                 CAST(ts AS TIMESTAMP) + CAST(json_extract_string(props, '$.k') AS INTEGER) * INTERVAL 1 MINUTE
                   AS label_ts FROM events)
SELECT request_id, prediction, label, strftime(ts, {_FMT}) AS ts, strftime(label_ts, {_FMT}) AS label_ts
FROM log JOIN lab ON request_id = rid AND label_ts >= ts AND label_ts <= ts + INTERVAL 1 HOUR""")
def stream_late_labels(spark, sf_dir):
    """Stream-stream join of predictions with labels arriving within one hour."""
    p = _log_stream(spark, sf_dir).select("request_id", "prediction", "ts")
    lab = _labels_from(table_stream(spark, sf_dir, "events"))
    j = S.late_labels(p, lab, "request_id", "ts", "label_ts", "1 hour")
    out = j.select("request_id", "prediction", "label", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                   F.date_format("label_ts", "yyyy-MM-dd HH:mm:ss").alias("label_ts"))
    return run_available(out, "append", "latelabels")


@query("stream_unlabelled",
       sql=with_views("log") + f"""
, lab AS (SELECT event_id AS rid, CAST(event_type = 'purchase' AS INTEGER) AS label,
                 CAST(ts AS TIMESTAMP) + 4 * CAST(json_extract_string(props, '$.k') AS INTEGER) * INTERVAL 1 MINUTE
                   AS label_ts FROM events)
SELECT request_id, prediction, label, strftime(ts, {_FMT}) AS ts, strftime(label_ts, {_FMT}) AS label_ts
FROM log LEFT JOIN lab ON request_id = rid AND label_ts >= ts AND label_ts <= ts + INTERVAL 1 HOUR""")
def stream_unlabelled(spark, sf_dir):
    """Every prediction with its label, or without one when both watermarks have passed its hour.

    Labels come 4 k minutes after their prediction, so some miss the hour; both inputs are
    delivered in time slices of their own.
    """
    events = table(spark, sf_dir, "events")
    labels = _labels_from(events, 4)

    def join(log, labels):
        p = V.log_from(log).select("request_id", "prediction", "ts")
        return S.late_labels(p, labels, "request_id", "ts", "label_ts", "1 hour", "left_outer").select(
            "request_id", "prediction", "label", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            F.date_format("label_ts", "yyyy-MM-dd HH:mm:ss").alias("label_ts"))

    out = run_deliveries(join, {"log": _arrivals(events, "ts", None, event_id=-1),
                                "labels": _arrivals(labels, "label_ts", None, request_id=-2)}, "unlabelled")
    return out.where(F.col("request_id") >= 0)


# Streaming drift split and histogram range (processing time, ms).
DRIFT_FROM = "2024-01-16 00:00:00"
DRIFT_LO, DRIFT_HI, DRIFT_BINS = 0.0, 500.0, 50


@query("stream_binned_drift",
       sql=with_views("log") + f"""
, bins AS (SELECT ts >= TIMESTAMP '{DRIFT_FROM}' AS cur,
                  CAST(least(greatest(floor((processing_time_ms - {DRIFT_LO}) / {(DRIFT_HI - DRIFT_LO) / DRIFT_BINS}), 0),
                             {DRIFT_BINS - 1}) AS INTEGER) AS bin FROM log),
  c AS (SELECT bin, count_if(NOT cur) AS nr, count_if(cur) AS nc FROM bins GROUP BY bin),
  f AS (SELECT sum(nr) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(nr) OVER () AS fr,
               sum(nc) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(nc) OVER () AS fc,
               sum(nr) OVER () AS n_reference, sum(nc) OVER () AS n_current FROM c)
SELECT max(abs(fr - fc)) AS ks_binned, CAST(first(n_reference) AS BIGINT) AS n_reference,
       CAST(first(n_current) AS BIGINT) AS n_current FROM f""",
       rounded="ks_binned")
def stream_binned_drift(spark, sf_dir):
    """Binned KS of the live latency stream (from mid-month) against the reference half."""
    # filter the raw column (before the view's cast) so the predicate reaches the parquet scan
    events = table(spark, sf_dir, "events").where(F.col("ts") < F.lit(DRIFT_FROM).cast("timestamp_ntz"))
    ref = V.log_from(events)
    ref_bins = S.binned_counts(ref, "processing_time_ms", DRIFT_LO, DRIFT_HI, DRIFT_BINS)
    live = _log_stream(spark, sf_dir).where(F.col("ts") >= F.lit(DRIFT_FROM).cast("timestamp"))
    cur_bins = run_available(S.binned_counts(live, "processing_time_ms", DRIFT_LO, DRIFT_HI, DRIFT_BINS),
                             "complete", "drift")
    return S.binned_ks(ref_bins, cur_bins, DRIFT_BINS)


@query("stream_window_drift",
       sql=with_views("log") + f"""
, ref AS (SELECT processing_time_ms AS v FROM log WHERE ts < TIMESTAMP '{DRIFT_FROM}'),
  cur AS (SELECT date_trunc('day', ts) AS ws, processing_time_ms AS v FROM log WHERE ts >= TIMESTAMP '{DRIFT_FROM}'),
  w AS (SELECT DISTINCT ws FROM cur),
  pts AS (SELECT ws, v, 1 AS r, 0 AS c FROM w, ref UNION ALL SELECT ws, v, 0, 1 FROM cur),
  cdf AS (SELECT ws, v, sum(sum(r)) OVER o / sum(sum(r)) OVER (PARTITION BY ws) AS fr,
                 sum(sum(c)) OVER o / sum(sum(c)) OVER (PARTITION BY ws) AS fc, sum(c) AS c
          FROM pts GROUP BY ws, v WINDOW o AS (PARTITION BY ws ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT strftime(ws, {_FMT}) AS window_start, strftime(ws + INTERVAL 1 DAY, {_FMT}) AS window_end,
       CAST(sum(c) AS BIGINT) AS n, max(abs(fr - fc)) AS ks_exact, true AS within_error
FROM cdf GROUP BY ws""",
       rounded="ks_exact")
def stream_window_drift(spark, sf_dir):
    """Drift of every closed day's latencies against the reference half, and whether the
    sketch's D keeps within its error of the exact one."""
    events = table(spark, sf_dir, "events")
    start = F.lit(DRIFT_FROM).cast("timestamp_ntz")
    reference, live = V.log_from(events.where(F.col("ts") < start)), events.where(F.col("ts") >= start)
    grid = S.reference_grid(reference, "processing_time_ms")
    days = run_deliveries(lambda events: S.windowed_drift(V.log_from(events), "ts", "processing_time_ms", grid, "1 day"),
                          {"events": _arrivals(live, "ts", None, value=0.0)}, "windowdrift")
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss")
    exact = S.windowed_ks(reference, V.log_from(live).withColumn("window_start", day), "processing_time_ms", "window_start")
    return days.join(exact.select("window_start", F.col("ks").alias("ks_exact")), "window_start").select(
        "window_start", "window_end", "n", "ks_exact",
        (F.abs(F.col("ks") - F.col("ks_exact")) <= F.col("ks_error") + 1e-9).alias("within_error"))


@query("stream_dedup",
       sql=with_views("log") + """
SELECT DISTINCT request_id, ts, prediction FROM log""")
def stream_dedup(spark, sf_dir):
    """Re-sent requests (every even k is sent twice) dropped within the watermark."""
    s = _log_stream(spark, sf_dir).select("request_id", "ts", "prediction", "k")
    resent = s.where(F.col("k") % 2 == 0)
    d = S.dedup(s.unionByName(resent), "request_id", "ts", "1 hour").drop("k")
    return run_available(d, "append", "dedup")


@query("stream_sequential_ab",
       sql=with_views("preds") + """
, r AS (SELECT CASE WHEN route THEN 'B' ELSE 'A' END AS arm, y_true,
               CASE WHEN route THEN pred_b ELSE pred_a END AS y_pred FROM preds),
  t AS (SELECT 'ab' AS test_id, CAST(1 AS BIGINT) AS batches,
               CAST(sum(CASE WHEN arm = 'A' AND y_true = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS a_correct,
               count_if(arm = 'A') AS a_total,
               CAST(sum(CASE WHEN arm = 'B' AND y_true = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS b_correct,
               count_if(arm = 'B') AS b_total FROM r),
  x AS (SELECT *, CASE WHEN a_total > 0 THEN a_correct / a_total ELSE 0.0 END AS rate_a,
               CASE WHEN b_total > 0 THEN b_correct / b_total ELSE 0.0 END AS rate_b FROM t),
  z AS (SELECT *, CASE WHEN a_total >= 1000 AND b_total >= 1000 THEN
                    CASE WHEN sqrt(rate_a * (1 - rate_a) / a_total + rate_b * (1 - rate_b) / b_total) > 0
                         THEN (rate_b - rate_a) / sqrt(rate_a * (1 - rate_a) / a_total + rate_b * (1 - rate_b) / b_total)
                         ELSE 0.0 END END AS zz FROM x),
  pz AS (SELECT *, CASE WHEN zz IS NOT NULL THEN """ + norm_p_sql("zz") + """ END AS p_value FROM z)
SELECT test_id, batches, a_correct, a_total, b_correct, b_total, rate_a, rate_b, p_value,
       coalesce(p_value < 0.050000000000000044, false) AS stopped,
       CASE WHEN rate_b > rate_a THEN 'B' ELSE 'A' END AS decision
FROM pz""",
       rounded="rate_a rate_b p_value")
def stream_sequential_ab(spark, sf_dir):
    """Stateful sequential A/B test over the order stream."""
    import uuid

    from calibra.session import scratch_path

    p = V.preds_from(table_stream(spark, sf_dir, "orders"))
    r = AB.routed(p, AB.route("o_orderkey"), "y_true", "pred_a", "pred_b", "score_a", "score_b")
    state = scratch_path(spark, f"streams/seqab-{uuid.uuid4().hex}")
    S.sequential_ab(r, state, F.lit("ab")).awaitTermination()
    return S.sequential_state(spark, state).drop("epoch", "expired")
