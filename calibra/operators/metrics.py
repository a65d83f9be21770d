"""Evaluation aggregates.

Every metric is derived from a handful of counts gathered in ONE aggregation
pass (partial aggregation map-side, final after a shuffle of a few rows per
group), then scalar math on the tiny result.  Curves and AUC aggregate by
distinct score first, so ties collapse before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.columns import safe_div
from calibra.functions.prefix import cumulative_counts


def confusion_counts(df: DataFrame, label: str = "y_true", pred: str = "y_pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """``tp fp fn tn n`` (BIGINT) per group; rows = true, cols = predicted."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    aggs = [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    ]
    return df.groupBy(*by).agg(*aggs)


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """E2 from E1 counts: accuracy, precision, recall, f1 (0 on a zero denominator)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": safe_div(tp + tn, tp + fp + fn + tn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
    })


def binary_metrics(df: DataFrame, label: str = "y_true", pred: str = "y_pred",
                   by: Sequence[str] = ()) -> DataFrame:
    """Positive-class metrics per group in one pass."""
    return metrics_from_counts(confusion_counts(df, label, pred, by))


def detection_stats(df: DataFrame, label: str = "y_true", pred: str = "y_pred",
                    by: Sequence[str] = ()) -> DataFrame:
    """Actual / predicted / correct positives, detection and false-alarm rates."""
    c = confusion_counts(df, label, pred, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by,
        (tp + fn).alias("actual_positive"),
        (tp + fp).alias("predicted_positive"),
        tp.alias("detected"),
        safe_div(tp, tp + fn).alias("detection_rate"),
        fp.alias("false_alarms"),
        safe_div(fp, fp + tn).alias("false_alarm_rate"),
        F.format_string("%d/%d", tp, tp + fn).alias("fraud_detected"),
    )


def classification_report(df: DataFrame, label: str = "y_true", pred: str = "y_pred",
                          by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision/recall/f1/support plus accuracy, macro and weighted avg.

    Long output ``(by..., label, precision, recall, f1_score, support)``; the
    class set is the union of true and predicted labels (multi-class works).
    The data is read once: a (label, pred) count table of classes^2 rows per
    group; everything else is computed from that small table.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(label).cast("string").alias("_t"),
                       F.col(pred).cast("string").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    per_true = pairs.groupBy(*by, F.col("_t").alias("label")).agg(
        F.sum("_n").alias("support"),
        F.sum(F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)).alias("tp"))
    per_pred = pairs.groupBy(*by, F.col("_p").alias("label")).agg(F.sum("_n").alias("predicted"))
    per = per_true.join(per_pred, [*by, "label"], "full_outer").select(
        *by, "label",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    per = per.select(
        *by, "label", "support", "tp",
        safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_div(F.col("tp"), F.col("support")).alias("recall"),
        safe_div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"))
    classes = per.select(*by, "label", "precision", "recall", "f1_score",
                         F.col("support").cast("bigint").alias("support"))
    summary = per.groupBy(*by).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    rows = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 safe_div(F.col("_correct"), F.col("_n")).alias("f1_score"),
                 F.col("_n").cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                 F.col("_n").cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), safe_div(F.col("wp"), F.col("_n")).alias("precision"),
                 safe_div(F.col("wr"), F.col("_n")).alias("recall"),
                 safe_div(F.col("wf"), F.col("_n")).alias("f1_score"),
                 F.col("_n").cast("bigint").alias("support"))))
    tail = summary.select(*by, rows.alias("_r")).select(*by, "_r.*")
    return classes.unionByName(tail)


def weighted_f1(df: DataFrame, label: str = "y_true", pred: str = "y_pred",
                by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted F1 over all classes."""
    rep = classification_report(df, label, pred, by)
    return rep.where(F.col("label") == "weighted avg").select(
        *by, F.col("f1_score").alias("weighted_f1"), F.col("support").alias("n"))


# ---------------------------------------------------------------- score curves

def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives/negatives per distinct score (ties collapse here)."""
    y = F.col(label).cast("int")
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).groupBy(
        *by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def _cumulative(df: DataFrame, label: str, score: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Per distinct score: tp/fp at threshold ``score >= t`` and below-counts."""
    y = F.col(label).cast("int")
    raw = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).select(
        *by, F.col(score).cast("double").alias("score"), y.alias("_y"))
    cum = cumulative_counts(raw, list(by), "score",
                            {"pos": F.count_if(F.col("_y") == 1), "neg": F.count_if(F.col("_y") == 0)},
                            buckets=buckets)
    # cum_* are "value <= t" sums; counts at threshold ">= t" come from the total.
    return cum.withColumns({
        "tp": F.col("tot_pos") - F.col("cum_pos") + F.col("pos"),
        "fp": F.col("tot_neg") - F.col("cum_neg") + F.col("neg"),
        "neg_below": F.col("cum_neg") - F.col("neg"),
    })


def roc_curve(df: DataFrame, label: str = "y_true", score: str = "score",
              by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """E5: ``(by..., threshold, fpr, tpr)`` at every distinct score (no point dropped)."""
    c = _cumulative(df, label, score, by, buckets)
    return c.select(*by, F.col("score").alias("threshold"),
                    safe_div(F.col("fp"), F.col("tot_neg")).alias("fpr"),
                    safe_div(F.col("tp"), F.col("tot_pos")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "y_true", score: str = "score",
             by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``(by..., threshold, precision, recall)`` at every distinct score."""
    c = _cumulative(df, label, score, by, buckets)
    return c.select(*by, F.col("score").alias("threshold"),
                    safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div(F.col("tp"), F.col("tot_pos")).alias("recall"))


def roc_auc(df: DataFrame, label: str = "y_true", score: str = "score",
            by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Tie-exact AUC = sum pos_i (neg_below_i + neg_i / 2) / (P N); 0.5 for one class."""
    c = _cumulative(df, label, score, by, buckets)
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_s"),
        F.first("tot_pos").alias("_p"), F.first("tot_neg").alias("_n"))
    return agg.select(*by, F.coalesce(F.try_divide(F.col("_s"), F.col("_p").cast("double") * F.col("_n").cast("double")),
                                      F.lit(0.5)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "y_true", score: str = "score",
                      by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """AP = sum over thresholds of (delta recall) * precision = sum pos_i / P * P_i."""
    c = _cumulative(df, label, score, by, buckets)
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_s"),
        F.first("tot_pos").alias("_p"))
    return agg.select(*by, safe_div(F.col("_s"), F.col("_p")).alias("average_precision"))


def score_metrics(df: DataFrame, label: str = "y_true", score: str = "score",
                  by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """AUC and AP from one cumulative pass (used by model comparison)."""
    c = _cumulative(df, label, score, by, buckets)
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_s"),
        F.sum(F.col("pos") * safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_ap"),
        F.first("tot_pos").alias("_p"), F.first("tot_neg").alias("_n"))
    return agg.select(
        *by,
        F.coalesce(F.try_divide(F.col("_s"), F.col("_p").cast("double") * F.col("_n").cast("double")),
                   F.lit(0.5)).alias("roc_auc"),
        safe_div(F.col("_ap"), F.col("_p")).alias("average_precision"))


def evaluation_summary(df: DataFrame, label: str = "y_true", pred: str = "y_pred", score: str = "score",
                       by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """E1/E2/E6/E8 in one read of the data: the confusion counts ride along as
    extra aggregates of the per-(group, score) count table that the AUC/AP
    running sums need anyway, then are summed per group.  Rows without a score
    (NULL/NaN) count in the confusion counts and what follows from them; only AUC
    and AP, which need an order, leave them out."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    value = F.col(score).cast("double")
    raw = df.select(*by, F.when(~F.isnan(value), value).alias("score"), y.alias("_y"), p.alias("_p"))
    yy, pp, scored = F.col("_y"), F.col("_p"), F.col("score").isNotNull()
    c = cumulative_counts(raw, list(by), "score", {
        "pos": F.count_if((yy == 1) & scored), "neg": F.count_if((yy == 0) & scored),
        "ctp": F.count_if((yy == 1) & (pp == 1)), "cfp": F.count_if((yy == 0) & (pp == 1)),
        "cfn": F.count_if((yy == 1) & (pp == 0)), "ctn": F.count_if((yy == 0) & (pp == 0))}, buckets=buckets)
    tp_t = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp_t = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0)).alias("_s"),
        F.sum(F.col("pos") * safe_div(tp_t, tp_t + fp_t)).alias("_ap"),
        F.first("tot_pos").alias("_p"), F.first("tot_neg").alias("_n"),
        *[F.sum(f"c{x}").alias(x) for x in ("tp", "fp", "fn", "tn")])
    agg = agg.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    out = metrics_from_counts(agg)
    return out.select(
        *by, "tp", "fp", "fn", "tn", "n", "accuracy", "precision", "recall", "f1",
        F.coalesce(F.try_divide(F.col("_s"), F.col("_p").cast("double") * F.col("_n").cast("double")),
                   F.lit(0.5)).alias("roc_auc"),
        safe_div(F.col("_ap"), F.col("_p")).alias("average_precision"))
