"""Queries for evaluation metrics (E1-E10) over the ``preds`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.operators import metrics as M
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V

_COUNTS_SQL = """
    count_if(y_true = 1 AND y_pred = 1) AS tp,
    count_if(y_true = 0 AND y_pred = 1) AS fp,
    count_if(y_true = 1 AND y_pred = 0) AS fn,
    count_if(y_true = 0 AND y_pred = 0) AS tn,
    count(*) AS n"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


_METRICS_SQL = f"""
    {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
    {_div('tp', 'tp + fp')} AS precision,
    {_div('tp', 'tp + fn')} AS recall,
    {_div('2 * tp', '2 * tp + fp + fn')} AS f1"""


@query("binary_metrics",
       sql=with_views("preds") + f"""
, c AS (SELECT {_COUNTS_SQL} FROM (SELECT y_true, pred_a AS y_pred FROM preds))
SELECT tp, fp, fn, tn, n, {_METRICS_SQL} FROM c""",
       rounded="accuracy precision recall f1")
def binary_metrics(spark, sf_dir):
    """E1+E2: confusion counts and positive-class metrics of model a."""
    p = V.preds(spark, sf_dir)
    return M.binary_metrics(p, "y_true", "pred_a")


@query("confusion_matrix",
       sql=with_views("preds_long") + f"""
SELECT model, {_COUNTS_SQL} FROM preds_long GROUP BY model""")
def confusion_matrix(spark, sf_dir):
    """E1 per model over the long prediction table."""
    return M.confusion_counts(V.preds_long(spark, sf_dir), "y_true", "y_pred", ["model"])


@query("detection_stats",
       sql=with_views("preds_long") + f"""
, c AS (SELECT model, {_COUNTS_SQL} FROM preds_long GROUP BY model)
SELECT model, tp + fn AS actual_positive, tp + fp AS predicted_positive, tp AS detected,
       {_div('tp', 'tp + fn')} AS detection_rate, fp AS false_alarms,
       {_div('fp', 'fp + tn')} AS false_alarm_rate,
       CAST(tp AS VARCHAR) || '/' || CAST(tp + fn AS VARCHAR) AS fraud_detected
FROM c""",
       rounded="detection_rate false_alarm_rate")
def detection_stats(spark, sf_dir):
    """E9 per model."""
    return M.detection_stats(V.preds_long(spark, sf_dir), "y_true", "y_pred", ["model"])


_REPORT_SQL = with_views("preds_long") + f"""
, pairs AS (SELECT model, CAST(y_true AS VARCHAR) AS t, CAST(y_pred AS VARCHAR) AS p, count(*) AS c
            FROM preds_long GROUP BY ALL),
  pt AS (SELECT model, t AS label, sum(c) AS support, sum(CASE WHEN t = p THEN c ELSE 0 END) AS tp
         FROM pairs GROUP BY ALL),
  pp AS (SELECT model, p AS label, sum(c) AS predicted FROM pairs GROUP BY ALL),
  per AS (SELECT coalesce(pt.model, pp.model) AS model, coalesce(pt.label, pp.label) AS label,
                 coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
          FROM pt FULL OUTER JOIN pp ON pt.model = pp.model AND pt.label = pp.label),
  m AS (SELECT model, label, support, tp, {_div('tp', 'predicted')} AS precision,
               {_div('tp', 'support')} AS recall, {_div('2 * tp', 'predicted + support')} AS f1_score
        FROM per),
  s AS (SELECT model, sum(support) AS n, sum(tp) AS correct, avg(precision) AS mp, avg(recall) AS mr,
               avg(f1_score) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr,
               sum(f1_score * support) AS wf FROM m GROUP BY model),
  report AS (
    SELECT model, label, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM m
    UNION ALL SELECT model, 'accuracy', NULL, NULL, {_div('correct', 'n')}, CAST(n AS BIGINT) FROM s
    UNION ALL SELECT model, 'macro avg', mp, mr, mf, CAST(n AS BIGINT) FROM s
    UNION ALL SELECT model, 'weighted avg', {_div('wp', 'n')}, {_div('wr', 'n')}, {_div('wf', 'n')},
                     CAST(n AS BIGINT) FROM s)
"""


@query("classification_report", sql=_REPORT_SQL + "SELECT * FROM report",
       rounded="precision recall f1_score")
def classification_report(spark, sf_dir):
    """E3 per model: per class, accuracy, macro avg, weighted avg."""
    return M.classification_report(V.preds_long(spark, sf_dir), "y_true", "y_pred", ["model"])


@query("weighted_f1",
       sql=_REPORT_SQL + "SELECT model, f1_score AS weighted_f1, support AS n FROM report "
                         "WHERE label = 'weighted avg'",
       rounded="weighted_f1")
def weighted_f1(spark, sf_dir):
    """E4 per model."""
    return M.weighted_f1(V.preds_long(spark, sf_dir), "y_true", "y_pred", ["model"])


_CUM_SQL = with_views("preds_long") + """
, sc AS (SELECT model, score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg
         FROM preds_long WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY model, score),
  cum AS (SELECT model, score, pos, neg,
                 sum(pos) OVER (PARTITION BY model ORDER BY score DESC
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                 sum(neg) OVER (PARTITION BY model ORDER BY score DESC
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                 sum(neg) OVER (PARTITION BY model ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below0,
                 sum(pos) OVER (PARTITION BY model) AS tot_pos,
                 sum(neg) OVER (PARTITION BY model) AS tot_neg
          FROM sc)
"""


@query("roc_curve",
       sql=_CUM_SQL + f"""
SELECT model, score AS threshold, {_div('fp', 'tot_neg')} AS fpr, {_div('tp', 'tot_pos')} AS tpr FROM cum""",
       rounded="threshold fpr tpr")
def roc_curve(spark, sf_dir):
    """E5 per model: (threshold, fpr, tpr) at every distinct score."""
    return M.roc_curve(V.preds_long(spark, sf_dir), "y_true", "score", ["model"])


@query("pr_curve",
       sql=_CUM_SQL + f"""
SELECT model, score AS threshold, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tot_pos')} AS recall
FROM cum""",
       rounded="threshold precision recall")
def pr_curve(spark, sf_dir):
    """E7 per model."""
    return M.pr_curve(V.preds_long(spark, sf_dir), "y_true", "score", ["model"])


_AUC_SQL = ("coalesce(sum(pos * (coalesce(neg_below0, 0) + neg / 2.0)) / "
            "NULLIF(CAST(max(tot_pos) * max(tot_neg) AS DOUBLE), 0), 0.5)")
_AP_SQL = f"coalesce(sum(pos * {_div('tp', 'tp + fp')}) / NULLIF(CAST(max(tot_pos) AS DOUBLE), 0), 0.0)"


@query("roc_auc", sql=_CUM_SQL + f"SELECT model, {_AUC_SQL} AS roc_auc FROM cum GROUP BY model",
       rounded="roc_auc")
def roc_auc(spark, sf_dir):
    """E6 per model, tie-exact."""
    return M.roc_auc(V.preds_long(spark, sf_dir), "y_true", "score", ["model"])


@query("average_precision",
       sql=_CUM_SQL + f"SELECT model, {_AP_SQL} AS average_precision FROM cum GROUP BY model",
       rounded="average_precision")
def average_precision(spark, sf_dir):
    """E8 per model."""
    return M.average_precision(V.preds_long(spark, sf_dir), "y_true", "score", ["model"])


@query("metrics_rollup",
       sql=with_views("preds") + f"""
, c AS (SELECT CASE WHEN route THEN 'B' ELSE 'A' END AS arm,
               strftime(date_trunc('year', day), '%Y') AS year,
               {_COUNTS_SQL}
        FROM (SELECT route, day, y_true,
                     CASE WHEN route THEN pred_b ELSE pred_a END AS y_pred FROM preds)
        GROUP BY ROLLUP (arm, year))
SELECT arm, year, tp, fp, fn, tn, n, {_METRICS_SQL} FROM c""",
       rounded="accuracy precision recall f1")
def metrics_rollup(spark, sf_dir):
    """E10 with ROLLUP over (arm, year): per arm-year, per arm and the grand total."""
    p = V.preds(spark, sf_dir).select(
        F.when(F.col("route"), "B").otherwise("A").alias("arm"),
        F.date_format("day", "yyyy").alias("year"),
        "y_true",
        F.when(F.col("route"), F.col("pred_b")).otherwise(F.col("pred_a")).alias("y_pred"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    y, q = F.col("y_true"), F.col("y_pred")
    counts = p.rollup("arm", "year").agg(
        F.count_if((y == 1) & (q == 1)).alias("tp"), F.count_if((y == 0) & (q == 1)).alias("fp"),
        F.count_if((y == 1) & (q == 0)).alias("fn"), F.count_if((y == 0) & (q == 0)).alias("tn"),
        F.count(F.lit(1)).alias("n"))
    return M.metrics_from_counts(counts)


@query("label_metrics",
       sql=f"""
, c AS (SELECT {_COUNTS_SQL} FROM (SELECT quality AS y_true, toxic AS y_pred FROM labels))
SELECT tp, fp, fn, tn, n, {_METRICS_SQL} FROM c""".replace(", c AS", "WITH c AS", 1),
       rounded="accuracy precision recall f1")
def label_metrics(spark, sf_dir):
    """E1/E2 on the human label table: quality as the truth, toxic as the prediction."""
    from calibra.sources.tables import table

    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    return M.binary_metrics(lab)


@query("unlabelled_predictions",
       sql="""
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unlabelled_predictions(spark, sf_dir):
    """Anti-join: scored documents that have no label yet (left-anti on doc_id)."""
    from calibra.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
