"""Queries over the run log and the model registry (L*, P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.functions.frames import scalar
from calibra.operators import runs as R
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V

_NEWEST = "ORDER BY start_time DESC, run_id"


@query("recent_runs",
       sql=with_views("runs") + f"""
SELECT run_id, experiment, start_time, row_number() OVER (PARTITION BY experiment {_NEWEST}) AS position
FROM runs QUALIFY position <= 10""")
def recent_runs(spark, sf_dir):
    """L2: newest 10 runs of every experiment."""
    r = R.recent_runs(V.runs(spark, sf_dir), 10)
    return r.select("run_id", "experiment", "start_time", "position")


@query("runs_to_delete",
       sql=with_views("runs") + f"""
SELECT run_id, experiment, start_time FROM runs
QUALIFY row_number() OVER (PARTITION BY experiment {_NEWEST}) > 50""")
def runs_to_delete(spark, sf_dir):
    """L3: runs beyond the newest 50 per experiment."""
    return R.runs_to_delete(V.runs(spark, sf_dir), 50).select("run_id", "experiment", "start_time")


@query("runs_export",
       sql=with_views("runs") + """
SELECT run_id, experiment, start_time, metric_k AS metrics_k, metric_value AS metrics_value,
       CAST(user_id AS VARCHAR) AS params_user_id FROM runs""",
       rounded="metrics_k metrics_value")
def runs_export(spark, sf_dir):
    """L4: runs flattened to one column per metric / param."""
    return R.export_runs(V.runs(spark, sf_dir), ["k", "value"], ["user_id"])


@query("metric_keys",
       sql=with_views("runs") + """
SELECT run_id, list_sort(list_filter(['value', 'k'], lambda x: (x = 'value' AND metric_value IS NOT NULL)
                                                           OR (x = 'k' AND metric_k IS NOT NULL)))[1:3] AS key_metrics
FROM runs""")
def metric_keys(spark, sf_dir):
    """The first three non-null metric names of every run."""
    r = V.runs(spark, sf_dir)
    return r.select("run_id", R.top_metric_keys(r).alias("key_metrics"))


_LATEST_SQL = with_views("model_version", "runs") + """
, l AS (SELECT name, current_stage, arg_max(version, (creation_timestamp, version)) AS version,
               arg_max(run_id, (creation_timestamp, version)) AS run_id,
               max(creation_timestamp) AS creation_timestamp
        FROM model_version GROUP BY name, current_stage)
"""


@query("latest_per_stage",
       sql=_LATEST_SQL + """
SELECT l.run_id, name, current_stage, version, creation_timestamp, metric_value AS value
FROM l LEFT JOIN runs ON l.run_id = runs.run_id""",
       rounded="value")
def latest_per_stage(spark, sf_dir):
    """Newest version per model and stage with its run metric."""
    return R.latest_per_stage(V.model_version(spark, sf_dir), V.runs(spark, sf_dir))


_HIST_SQL = with_views("model_version", "runs") + """
, h AS (SELECT m.run_id, name, version, current_stage, creation_timestamp, metric_value AS value
        FROM model_version m LEFT JOIN runs ON m.run_id = runs.run_id)
"""


@query("performance_history", sql=_HIST_SQL + "SELECT * FROM h ORDER BY name, creation_timestamp, version",
       rounded="value")
def performance_history(spark, sf_dir):
    """Versions with run metrics ordered by creation time."""
    return R.performance_history(V.model_version(spark, sf_dir), V.runs(spark, sf_dir))


@query("metric_trend",
       sql=_HIST_SQL + """
SELECT name, arg_max(value, (creation_timestamp, version)) AS latest, max(value) AS best,
       arg_min(value, (creation_timestamp, version)) AS first, count(*) AS versions,
       CASE WHEN arg_max(value, (creation_timestamp, version)) > arg_min(value, (creation_timestamp, version))
            THEN '+' ELSE '-' END AS trend,
       CASE WHEN arg_max(value, (creation_timestamp, version)) < arg_min(value, (creation_timestamp, version))
            THEN 'DECLINING' ELSE 'STABLE_OR_IMPROVING' END AS direction
FROM h WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY name""",
       rounded="latest best first")
def metric_trend(spark, sf_dir):
    """Latest, best and trend of the run metric over versions."""
    h = R.performance_history(V.model_version(spark, sf_dir), V.runs(spark, sf_dir))
    return R.metric_trend(h)


@query("experiment_summary",
       sql=with_views("runs") + """
, l AS (SELECT experiment, count(*) AS total_runs,
               arg_max(run_id, (start_time, -run_id)) AS rid FROM runs GROUP BY experiment)
SELECT experiment, total_runs, least(total_runs, 10) AS shown_runs,
       substr(CAST(rid AS VARCHAR), 1, 8) AS latest_run_prefix,
       (SELECT list_sort(list_filter(['value', 'k'], lambda x: (x = 'value' AND metric_value IS NOT NULL)
                                                         OR (x = 'k' AND metric_k IS NOT NULL)))[1:3]
        FROM runs WHERE runs.run_id = l.rid) AS key_metrics
FROM l""")
def experiment_summary(spark, sf_dir):
    """Runs per experiment with the newest run's id prefix and metric names."""
    return R.experiment_summary(V.runs(spark, sf_dir))


@query("model_versions",
       sql=with_views("model_version") + """
SELECT name, count(*) AS versions, max(version) AS latest_version, list_sort(list_distinct(list(current_stage))) AS stages
FROM model_version GROUP BY name""")
def model_versions(spark, sf_dir):
    """Versions per registered model."""
    return R.list_versions(V.model_version(spark, sf_dir))


@query("promote_latest",
       sql=with_views("model_version") + """
, c AS (SELECT name, arg_max(version, (creation_timestamp, version)) AS version
        FROM model_version WHERE current_stage = 'None' GROUP BY name)
SELECT m.name, m.version, run_id,
       CASE WHEN c.version IS NOT NULL THEN 'Staging' ELSE current_stage END AS current_stage, creation_timestamp
FROM model_version m LEFT JOIN c ON m.name = c.name AND m.version = c.version""")
def promote_latest(spark, sf_dir):
    """Newest unstaged version of every model promoted to Staging."""
    return R.promote_latest(V.model_version(spark, sf_dir))


@query("production_flags",
       sql=with_views("model_version", "preds") + """
, c AS (SELECT count_if(y_true = 1 AND pred_a = 1) AS tp, count_if(y_true = 0 AND pred_a = 1) AS fp,
               count_if(y_true = 1 AND pred_a = 0) AS fn FROM preds),
  d AS (SELECT 0.85 - coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) > 0.05 AS should_retrain FROM c)
SELECT name, version, run_id,
       '{"needs_retraining":"' || CASE WHEN should_retrain THEN 'true' ELSE 'false' END || '"}' AS tags
FROM model_version, d WHERE current_stage = 'Production'""")
def production_flags(spark, sf_dir):
    """Production versions tagged with the F1-degradation retraining decision."""
    from calibra.operators import metrics as M

    cur = M.binary_metrics(V.preds(spark, sf_dir), "y_true", "pred_a")
    decision = scalar(cur.select(((F.lit(0.85) - F.col("f1")) > 0.05).alias("should_retrain")))
    return R.flag_production(V.model_version(spark, sf_dir), bool(decision))
