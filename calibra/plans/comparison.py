"""Queries for model comparison (C1-C7, M14) and A/B testing."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.operators import abtest as AB
from calibra.operators import compare as C
from calibra.plans.evaluation import _AP_SQL, _AUC_SQL, _COUNTS_SQL, _div
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V
from calibra.sources.tables import table

_ERFC = ("(1.0 / (1.0 + 0.3275911 * ({x}))) * (0.254829592 + (1.0 / (1.0 + 0.3275911 * ({x}))) * "
         "(-0.284496736 + (1.0 / (1.0 + 0.3275911 * ({x}))) * (1.421413741 + (1.0 / (1.0 + 0.3275911 * ({x}))) "
         "* (-1.453152027 + (1.0 / (1.0 + 0.3275911 * ({x}))) * 1.061405429)))) * exp(-(({x}) * ({x})))")


def erfc_sql(x: str) -> str:
    return "(" + _ERFC.format(x=x) + ")"


def norm_p_sql(z: str) -> str:
    return erfc_sql(f"abs({z}) / sqrt(2.0)")


def chi2_p_sql(s: str) -> str:
    return erfc_sql(f"sqrt(({s}) / 2.0)")


_MM_SQL = with_views("preds_long") + f"""
, c AS (SELECT model, {_COUNTS_SQL} FROM preds_long GROUP BY model),
  sc AS (SELECT model, score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg
         FROM preds_long WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY model, score),
  cum AS (SELECT model, score, pos, neg,
                 sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                 sum(neg) OVER (PARTITION BY model ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below0,
                 sum(pos) OVER (PARTITION BY model) AS tot_pos, sum(neg) OVER (PARTITION BY model) AS tot_neg
          FROM sc),
  s AS (SELECT model, {_AUC_SQL} AS roc_auc, {_AP_SQL} AS avg_precision FROM cum GROUP BY model),
  mm AS (SELECT c.model, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision,
                {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1_score,
                roc_auc, avg_precision, n AS n_samples
         FROM c LEFT JOIN s ON c.model = s.model)
"""


def _mm(spark, sf_dir):
    return C.model_metrics(V.preds_long(spark, sf_dir))


@query("model_metrics", sql=_MM_SQL + "SELECT * FROM mm",
       rounded="accuracy precision recall f1_score roc_auc avg_precision")
def model_metrics(spark, sf_dir):
    """Every model on the same rows."""
    return _mm(spark, sf_dir)


@query("model_rankings",
       sql=_MM_SQL + """
, long AS (UNPIVOT mm ON accuracy, precision, recall, f1_score, roc_auc, avg_precision
           INTO NAME metric VALUE value)
SELECT metric, model, value,
       row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS position
FROM long""",
       rounded="value")
def model_rankings(spark, sf_dir):
    """Per-metric ranking of models."""
    return C.model_rankings(_mm(spark, sf_dir))


_OVERALL = "f1_score * 0.4 + roc_auc * 0.3 + precision * 0.15 + recall * 0.15"


@query("overall_ranking",
       sql=_MM_SQL + f"""
SELECT model, {_OVERALL} AS overall_score,
       row_number() OVER (ORDER BY {_OVERALL} DESC, model) AS position
FROM mm""",
       rounded="overall_score")
def overall_ranking(spark, sf_dir):
    """Weighted overall score and rank."""
    return C.overall_ranking(_mm(spark, sf_dir))


@query("best_models",
       sql=_MM_SQL + f"""
SELECT first(model ORDER BY f1_score DESC, model) AS by_f1,
       first(model ORDER BY roc_auc DESC, model) AS by_auc,
       first(model ORDER BY {_OVERALL} DESC, model) AS overall
FROM mm""")
def best_models(spark, sf_dir):
    """C4: best model by F1, AUC and overall."""
    return C.best_models(_mm(spark, sf_dir))


def _mcnemar_pair_sql(a: str, b: str) -> str:
    bb = f"count_if(pred_{a} = 0 AND pred_{b} = 1)"
    cc = f"count_if(pred_{a} = 1 AND pred_{b} = 0)"
    complete = (f"(count_if(pred_{a} = 0) > 0 AND count_if(pred_{a} = 1) > 0 "
                f"AND count_if(pred_{b} = 0) > 0 AND count_if(pred_{b} = 1) > 0)")
    return f"SELECT '{a}' AS model_a, '{b}' AS model_b, {bb} AS b, {cc} AS c, {complete} AS complete FROM preds"


@query("mcnemar",
       sql=with_views("preds") + """
, pc AS (""" + " UNION ALL ".join(_mcnemar_pair_sql(a, b) for a, b in [("a", "b"), ("a", "c"), ("b", "c")]) + """),
  st AS (SELECT *, CASE WHEN complete THEN
                     CASE WHEN b + c > 0 THEN CAST((b - c) * (b - c) AS DOUBLE) / (b + c) ELSE 0.0 END END
                   AS statistic FROM pc)
SELECT model_a, model_b, b, c, complete, statistic, """ + chi2_p_sql("statistic") + """ AS p_value,
       """ + chi2_p_sql("statistic") + """ < 0.05 AS significant
FROM st""",
       rounded="statistic p_value")
def mcnemar(spark, sf_dir):
    """McNemar test for all model pairs on the wide prediction table."""
    p = V.preds(spark, sf_dir)
    return C.mcnemar(p, {m: f"pred_{m}" for m in V.MODELS})


_WF1_ARM_SQL = with_views("preds") + f"""
, long AS (SELECT 'A' AS arm, y_true, pred_a AS y_pred FROM preds
           UNION ALL SELECT 'B', y_true, pred_b FROM preds),
  pairs AS (SELECT arm, CAST(y_true AS VARCHAR) AS t, CAST(y_pred AS VARCHAR) AS p, count(*) AS c
            FROM long GROUP BY ALL),
  pt AS (SELECT arm, t AS label, sum(c) AS support, sum(CASE WHEN t = p THEN c ELSE 0 END) AS tp
         FROM pairs GROUP BY ALL),
  pp AS (SELECT arm, p AS label, sum(c) AS predicted FROM pairs GROUP BY ALL),
  per AS (SELECT coalesce(pt.arm, pp.arm) AS arm, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
                 coalesce(predicted, 0) AS predicted
          FROM pt FULL OUTER JOIN pp ON pt.arm = pp.arm AND pt.label = pp.label),
  wf AS (SELECT arm, {_div('sum(' + _div('2 * tp', 'predicted + support') + ' * support)', 'sum(support)')} AS wf1,
                {_div('sum(tp)', 'sum(support)')} AS acc
         FROM per GROUP BY arm),
  one AS (SELECT max(CASE WHEN arm = 'A' THEN acc END) AS accuracy_a, max(CASE WHEN arm = 'B' THEN acc END) AS accuracy_b,
                 max(CASE WHEN arm = 'A' THEN wf1 END) AS f1_a, max(CASE WHEN arm = 'B' THEN wf1 END) AS f1_b FROM wf)
"""


@query("quick_compare",
       sql=_WF1_ARM_SQL + """
SELECT accuracy_a, accuracy_b, f1_a, f1_b, CASE WHEN f1_a > f1_b THEN 'A' ELSE 'B' END AS winner,
       abs(f1_a - f1_b) / NULLIF(least(f1_a, f1_b), 0) * 100.0 AS improvement_pct
FROM one""",
       rounded="accuracy_a accuracy_b f1_a f1_b improvement_pct")
def quick_compare(spark, sf_dir):
    """Weighted-F1 comparison of models a and b on all rows."""
    return C.quick_compare(V.preds(spark, sf_dir), "y_true", "pred_a", "pred_b")


@query("model_agreement",
       sql=with_views("preds") + """
SELECT count(*) AS n, CAST(sum(CAST(pred_a = pred_b AS INTEGER)) AS BIGINT) AS agreements,
       avg(CAST(pred_a = pred_b AS INTEGER)::DOUBLE) AS agreement_rate,
       avg(abs(score_a - score_b)) AS mean_probability_diff, max(abs(score_a - score_b)) AS max_probability_diff
FROM preds""",
       rounded="agreement_rate mean_probability_diff max_probability_diff")
def model_agreement(spark, sf_dir):
    """Shadow scoring of model b next to model a."""
    return C.model_agreement(V.preds(spark, sf_dir), "pred_a", "pred_b", "score_a", "score_b")


# ---------------------------------------------------------------- A/B

_ROUTED_SQL = with_views("preds") + """
, r AS (SELECT o_orderkey, CASE WHEN route THEN 'B' ELSE 'A' END AS arm, y_true,
               CASE WHEN route THEN pred_b ELSE pred_a END AS y_pred,
               CASE WHEN route THEN score_b ELSE score_a END AS score
        FROM preds)
"""


def _routed(spark, sf_dir):
    p = V.preds(spark, sf_dir)
    return AB.routed(p, AB.route("o_orderkey"), "y_true", "pred_a", "pred_b", "score_a", "score_b",
                     keep=("o_orderkey",))


@query("ab_route",
       sql=with_views("preds") + """
SELECT CASE WHEN route THEN 'B' ELSE 'A' END AS arm, count(*) AS n FROM preds GROUP BY 1""")
def ab_route(spark, sf_dir):
    """Sticky hash routing; arm sizes."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(AB.route("o_orderkey").alias("arm")).agg(F.count(F.lit(1)).alias("n"))


_ARM_SQL = _ROUTED_SQL + f"""
, c AS (SELECT arm, {_COUNTS_SQL} FROM r GROUP BY arm),
  sc AS (SELECT arm, score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM r GROUP BY arm, score),
  cum AS (SELECT arm, score, pos, neg,
                 sum(neg) OVER (PARTITION BY arm ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   AS neg_below0,
                 sum(pos) OVER (PARTITION BY arm) AS tot_pos, sum(neg) OVER (PARTITION BY arm) AS tot_neg
          FROM sc),
  auc AS (SELECT arm, {_AUC_SQL} AS roc_auc FROM cum GROUP BY arm),
  am AS (SELECT c.arm, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision,
                {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1_score, roc_auc,
                tn, fp, fn, tp, n AS sample_size
         FROM c LEFT JOIN auc ON c.arm = auc.arm)
"""


@query("ab_arm_metrics", sql=_ARM_SQL + "SELECT * FROM am",
       rounded="accuracy precision recall f1_score roc_auc")
def ab_arm_metrics(spark, sf_dir):
    """A1: fixed-horizon A/B test, metrics per arm."""
    return AB.arm_metrics(_routed(spark, sf_dir))


def _imp(m: str) -> str:
    a = f"max(CASE WHEN arm = 'A' THEN {m} END)"
    b = f"max(CASE WHEN arm = 'B' THEN {m} END)"
    return f"CASE WHEN {a} <> 0 THEN ({b} - {a}) / {a} * 100.0 ELSE 0.0 END"


@query("ab_comparison",
       sql=_ARM_SQL + """
, imp AS (SELECT """ + ", ".join(f"{_imp(m)} AS {m}_improvement" for m in AB.AB_METRICS) + """ FROM am),
  best AS (SELECT *, greatest(""" + ", ".join(
           f"{{'mag': abs({m}_improvement), 'ord': {-i}, 'imp': {m}_improvement}}"
           for i, m in enumerate(AB.AB_METRICS)) + """) AS b FROM imp)
SELECT """ + ", ".join(f"{m}_improvement" for m in AB.AB_METRICS) + """,
       CASE WHEN b.mag > 0 THEN CASE WHEN b.imp > 0 THEN 'B' ELSE 'A' END END AS winner,
       CASE WHEN b.mag > 0 THEN b.imp ELSE 0.0 END AS max_improvement
FROM best""",
       rounded=" ".join(f"{m}_improvement" for m in AB.AB_METRICS) + " max_improvement")
def ab_comparison(spark, sf_dir):
    """A2: relative change per metric and the winner."""
    return AB.compare_arms(AB.arm_metrics(_routed(spark, sf_dir)))


@query("ab_significance",
       sql=_ARM_SQL + """
, w AS (SELECT max(CASE WHEN arm = 'A' THEN f1_score END) AS f1_a, max(CASE WHEN arm = 'B' THEN f1_score END) AS f1_b,
               max(CASE WHEN arm = 'A' THEN sample_size END) AS n_a,
               max(CASE WHEN arm = 'B' THEN sample_size END) AS n_b FROM am),
  s AS (SELECT *, sqrt(f1_a * (1 - f1_a) / n_a + f1_b * (1 - f1_b) / n_b) AS se FROM w),
  z AS (SELECT *, CASE WHEN se > 0 THEN (f1_b - f1_a) / se WHEN se = 0 THEN 0.0 END AS t_statistic FROM s)
SELECT f1_a, f1_b, n_a, n_b, t_statistic, """ + norm_p_sql("t_statistic") + """ AS p_value,
       """ + norm_p_sql("t_statistic") + """ < 0.05 AS significant
FROM z""",
       rounded="f1_a f1_b t_statistic p_value")
def ab_significance(spark, sf_dir):
    """A3: two-proportion z test on F1 between arms."""
    return AB.significance(AB.arm_metrics(_routed(spark, sf_dir)))


@query("ab_prediction_log",
       sql=_ROUTED_SQL + """
SELECT o_orderkey AS sample_id, arm AS "group", y_pred AS prediction, score AS probability, y_true AS true_label
FROM r""",
       rounded="probability")
def ab_prediction_log(spark, sf_dir):
    """A4: per-request routed prediction log (every order)."""
    r = _routed(spark, sf_dir)
    return r.select(F.col("o_orderkey").alias("sample_id"), F.col("arm").alias("group"),
                    F.col("y_pred").alias("prediction"), F.col("score").alias("probability"),
                    F.col("y_true").alias("true_label"))


@query("ab_simple_decision",
       sql=_ROUTED_SQL + f"""
, c AS (SELECT arm, {_COUNTS_SQL} FROM r GROUP BY arm),
  w AS (SELECT max(CASE WHEN arm = 'A' THEN n END) AS group_a_count, max(CASE WHEN arm = 'B' THEN n END) AS group_b_count,
               max(CASE WHEN arm = 'A' THEN {_div('2 * tp', '2 * tp + fp + fn')} END) AS f1_a,
               max(CASE WHEN arm = 'B' THEN {_div('2 * tp', '2 * tp + fp + fn')} END) AS f1_b FROM c),
  d AS (SELECT *, CASE WHEN f1_a = 0 AND f1_b = 0 THEN 0.0
                       WHEN f1_a = 0 THEN CASE WHEN f1_b > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END
                       ELSE (f1_b - f1_a) / f1_a * 100.0 END AS f1_improvement,
                  CASE WHEN f1_a = 0 AND f1_b = 0 THEN 'Tie'
                       WHEN f1_a = 0 THEN CASE WHEN f1_b > 0 THEN 'B' ELSE 'Tie' END
                       ELSE CASE WHEN f1_b > f1_a THEN 'B' ELSE 'A' END END AS winner FROM w)
SELECT group_a_count, group_b_count, f1_a, f1_b, f1_improvement, winner,
       CASE WHEN f1_improvement = 'Infinity'::DOUBLE THEN true ELSE abs(f1_improvement) > 2.0 END AS significant
FROM d""",
       rounded="f1_a f1_b f1_improvement")
def ab_simple_decision(spark, sf_dir):
    """A4: F1-only comparison with Tie/inf rules."""
    return AB.simple_decision(_routed(spark, sf_dir))


_SEQ_SQL = _ROUTED_SQL + """
, rk AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS batch FROM r),
  pb AS (SELECT batch, count(*) AS samples,
                sum(CASE WHEN arm = 'A' AND y_true = y_pred THEN 1 ELSE 0 END) AS a_correct,
                sum(CASE WHEN arm = 'B' AND y_true = y_pred THEN 1 ELSE 0 END) AS b_correct,
                count_if(arm = 'A') AS a_n, count_if(arm = 'B') AS b_n FROM rk GROUP BY batch),
  cb AS (SELECT batch, samples,
                sum(a_correct) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS ca,
                sum(b_correct) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS cbb,
                sum(a_n) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS total_a,
                sum(b_n) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS total_b FROM pb),
  rt AS (SELECT batch, samples, """ + _div("ca", "total_a") + " AS rate_a, " + _div("cbb", "total_b") + """ AS rate_b,
                CAST(total_a AS BIGINT) AS total_a, CAST(total_b AS BIGINT) AS total_b FROM cb),
  zz AS (SELECT *, CASE WHEN rate_a > 0 THEN (rate_b - rate_a) / rate_a * 100.0 ELSE 0.0 END AS improvement,
                CASE WHEN total_a >= 1000 AND total_b >= 1000 THEN
                  CASE WHEN sqrt(rate_a * (1 - rate_a) / total_a + rate_b * (1 - rate_b) / total_b) > 0
                       THEN (rate_b - rate_a) / sqrt(rate_a * (1 - rate_a) / total_a + rate_b * (1 - rate_b) / total_b)
                       ELSE 0.0 END END AS z_score FROM rt),
  pz AS (SELECT *, """ + norm_p_sql("z_score") + """ AS p_value FROM zz),
  bt AS (SELECT *, coalesce(p_value < 0.050000000000000044, false) AS significant FROM pz),
  stop AS (SELECT coalesce(min(CASE WHEN significant THEN batch END), max(batch)) AS stop_batch FROM bt),
  kept AS (SELECT bt.* FROM bt, stop WHERE batch <= stop_batch)
"""


@query("ab_sequential", sql=_SEQ_SQL + "SELECT * FROM kept",
       rounded="rate_a rate_b improvement z_score p_value")
def ab_sequential(spark, sf_dir):
    """A5: sequential test in batches of 100 (order key order), cut at the first significant batch."""
    b = AB.sequential_batches(_routed(spark, sf_dir), "o_orderkey")
    return AB.sequential_result(b)[0]


@query("ab_sequential_decision",
       sql=_SEQ_SQL + """
SELECT max(batch) AS batches_run, CAST(max(CAST(significant AS INTEGER)) AS BOOLEAN) AS early_stopped,
       arg_max(CASE WHEN rate_b > rate_a THEN 'B' ELSE 'A' END, batch) AS final_decision
FROM kept""")
def ab_sequential_decision(spark, sf_dir):
    """A5: stop batch and final decision of the sequential test."""
    b = AB.sequential_batches(_routed(spark, sf_dir), "o_orderkey")
    return AB.sequential_result(b)[1]


@query("test_data_info",
       sql=with_views("tx") + """
SELECT count(*) AS n_samples, 4 AS n_features, avg(CAST(Class AS DOUBLE)) AS fraud_rate,
       count_if(Class = 0) AS class_0, count_if(Class = 1) AS class_1 FROM tx""",
       rounded="fraud_rate")
def test_data_info(spark, sf_dir):
    """Size, feature count, positive rate and class counts of the transaction table."""
    return C.test_data_info(V.tx(spark, sf_dir), "Class", V.TX_FEATURES)


@query("ab_result_log",
       sql=_ARM_SQL + """
, w AS (SELECT max(CASE WHEN arm = 'A' THEN f1_score END) AS group_a_f1,
               max(CASE WHEN arm = 'B' THEN f1_score END) AS group_b_f1,
               max(CASE WHEN arm = 'A' THEN roc_auc END) AS group_a_auc,
               max(CASE WHEN arm = 'B' THEN roc_auc END) AS group_b_auc FROM am)
SELECT 'ab_testing' AS experiment,
       round(group_a_f1, 6) AS metric_group_a_f1, round(group_b_f1, 6) AS metric_group_b_f1,
       round(group_a_auc, 6) AS metric_group_a_auc, round(group_b_auc, 6) AS metric_group_b_auc,
       CASE WHEN group_b_f1 > group_a_f1 THEN 'B' ELSE 'A' END AS param_winner
FROM w""")
def ab_result_log(spark, sf_dir):
    """The A/B result as a run-log row (finite numbers -> metrics, others -> params)."""
    am = AB.arm_metrics(_routed(spark, sf_dir))
    w = am.agg(*[F.max(F.when(F.col("arm") == a, F.col(m))).alias(f"group_{a.lower()}_{n}")
                 for a in ("A", "B") for m, n in (("f1_score", "f1"), ("roc_auc", "auc"))])
    w = w.withColumn("winner", F.when(F.col("group_b_f1") > F.col("group_a_f1"), "B").otherwise("A"))
    names = ["group_a_f1", "group_b_f1", "group_a_auc", "group_b_auc"]
    row = AB.result_log(w, names, ["winner"])
    return row.select("experiment", *[F.round(F.col("metrics")[n], 6).alias(f"metric_{n}") for n in names],
                      F.col("params")["winner"].alias("param_winner"))
