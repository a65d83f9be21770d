"""Model comparison (C1-C7) and shadow scoring agreement.

Input is either a long prediction table ``(key, model, y_true, y_pred, score)``
or a wide one with one prediction column per model.  All statistics come from
single aggregation passes; rankings are windows over the per-model result
(one row per model), never over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.columns import chi2_1_sf, safe_div
from calibra.operators import metrics as M

# Metrics that models are ranked by, in this order.
RANK_METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "avg_precision"]
# Overall ranking weights.
OVERALL_WEIGHTS = {"f1_score": 0.4, "roc_auc": 0.3, "precision": 0.15, "recall": 0.15}


def model_metrics(long: DataFrame, model: str = "model", label: str = "y_true",
                  pred: str = "y_pred", score: str = "score", buckets: int | None = None) -> DataFrame:
    """Accuracy, precision, recall, f1_score, roc_auc, avg_precision per model."""
    s = M.evaluation_summary(long, label, pred, score, [model], buckets)
    return s.select(model, "accuracy", "precision", "recall", F.col("f1").alias("f1_score"), "roc_auc",
                    F.col("average_precision").alias("avg_precision"), F.col("n").alias("n_samples"))


def model_rankings(mm: DataFrame, model: str = "model",
                   metrics: Sequence[str] = RANK_METRICS) -> DataFrame:
    """Position of each model per metric (descending value, name breaks ties)."""
    long = mm.unpivot([model], list(metrics), "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), F.asc(model))
    return long.select("metric", model, "value", F.row_number().over(w).alias("position"))


def overall_ranking(mm: DataFrame, model: str = "model",
                    weights: Mapping[str, float] = OVERALL_WEIGHTS) -> DataFrame:
    """Weighted score 0.4 F1 + 0.3 AUC + 0.15 P + 0.15 R and its rank.

    The window runs over the per-model table (one row per model).
    """
    score = None
    for m, w in weights.items():
        term = F.col(m) * F.lit(w)
        score = term if score is None else score + term
    scored = mm.select(model, score.alias("overall_score"))
    w = Window.orderBy(F.desc("overall_score"), F.asc(model))
    return scored.withColumn("position", F.row_number().over(w))


def best_models(mm: DataFrame, model: str = "model") -> DataFrame:
    """C4: best model by F1, by AUC and overall (ties -> smallest name)."""
    overall = sum(F.col(m) * F.lit(w) for m, w in OVERALL_WEIGHTS.items())
    return mm.agg(
        F.min_by(model, F.struct(-F.col("f1_score"), F.col(model))).alias("by_f1"),
        F.min_by(model, F.struct(-F.col("roc_auc"), F.col(model))).alias("by_auc"),
        F.min_by(model, F.struct(-overall, F.col(model))).alias("overall"))


def pivot_predictions(long: DataFrame, models: Sequence[str], key: str,
                      model: str = "model", pred: str = "y_pred") -> DataFrame:
    """Long -> wide ``(key, pred_<m>...)``; the model list is given, so no extra job."""
    return long.groupBy(key).pivot(model, list(models)).agg(F.first(pred)).select(
        key, *[F.col(m).alias(f"pred_{m}") for m in models])


def mcnemar(wide: DataFrame, pred_cols: Mapping[str, str], on: str = "prediction",
            label: str | None = None) -> DataFrame:
    """McNemar test for every model pair i < j in one aggregation pass.

    ``b`` = rows with (a=0, b=1), ``c`` = rows with (a=1, b=0) of the crosstab of
    the two prediction columns (``on="correctness"`` uses correct/incorrect
    instead).  stat = (b-c)^2/(b+c) (0 if b+c=0), p = chi2(1) upper tail.
    ``complete`` is false when the crosstab is not 2x2 (then no statistic).
    """
    names = list(pred_cols)
    cols = {}
    for m in names:
        c = F.col(pred_cols[m]).cast("int")
        if on == "correctness":
            c = (c == F.col(label).cast("int")).cast("int")
        cols[m] = c
    aggs, pairs = [], []
    for i, a in enumerate(names):
        aggs += [F.count_if(cols[a] == 0).alias(f"_z_{a}"), F.count_if(cols[a] == 1).alias(f"_o_{a}")]
        for b in names[i + 1:]:
            pairs.append((a, b))
            aggs += [F.count_if((cols[a] == 0) & (cols[b] == 1)).alias(f"_b_{a}_{b}"),
                     F.count_if((cols[a] == 1) & (cols[b] == 0)).alias(f"_c_{a}_{b}")]
    counts = wide.agg(*aggs)
    rows = []
    for a, b in pairs:
        bb, cc = F.col(f"_b_{a}_{b}"), F.col(f"_c_{a}_{b}")
        complete = ((F.col(f"_z_{a}") > 0) & (F.col(f"_o_{a}") > 0)
                    & (F.col(f"_z_{b}") > 0) & (F.col(f"_o_{b}") > 0))
        stat = F.when(bb + cc > 0, safe_div((bb - cc).cast("double") * (bb - cc).cast("double"), bb + cc)).otherwise(F.lit(0.0))
        stat = F.when(complete, stat)
        rows.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                             bb.alias("b"), cc.alias("c"), complete.alias("complete"),
                             stat.alias("statistic")))
    out = counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    p = chi2_1_sf(F.col("statistic"))
    return out.withColumns({"p_value": p, "significant": p < 0.05})


def quick_compare(df: DataFrame, label: str, pred_a: str, pred_b: str) -> DataFrame:
    """Weighted F1 of two prediction columns; A wins only if strictly greater.

    improvement = |f1_a - f1_b| / min(f1_a, f1_b) * 100 (NULL when the minimum is 0).
    """
    long = df.select(label, F.explode(F.array(
        F.struct(F.lit("A").alias("arm"), F.col(pred_a).alias("y_pred")),
        F.struct(F.lit("B").alias("arm"), F.col(pred_b).alias("y_pred")))).alias("_x")).select(
        label, "_x.arm", "_x.y_pred")
    acc = long.groupBy("arm").agg(F.avg((F.col(label) == F.col("y_pred")).cast("double")).alias("acc"))
    wf = M.weighted_f1(long, label, "y_pred", ["arm"]).join(acc, "arm")
    one = wf.agg(
        F.max(F.when(F.col("arm") == "A", F.col("acc"))).alias("accuracy_a"),
        F.max(F.when(F.col("arm") == "B", F.col("acc"))).alias("accuracy_b"),
        F.max(F.when(F.col("arm") == "A", F.col("weighted_f1"))).alias("f1_a"),
        F.max(F.when(F.col("arm") == "B", F.col("weighted_f1"))).alias("f1_b"))
    fa, fb = F.col("f1_a"), F.col("f1_b")
    return one.select(
        "accuracy_a", "accuracy_b", "f1_a", "f1_b",
        F.when(fa > fb, "A").otherwise("B").alias("winner"),
        (F.try_divide(F.abs(fa - fb), F.least(fa, fb)) * 100.0).alias("improvement_pct"))


def model_agreement(df: DataFrame, pred_main: str, pred_base: str,
                    prob_main: str, prob_base: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement rate and mean/max |p_main - p_base| of shadow scoring."""
    agree = (F.col(pred_main) == F.col(pred_base)).cast("int")
    diff = F.abs(F.col(prob_main) - F.col(prob_base))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(agree).cast("bigint").alias("agreements"),
        F.avg(agree.cast("double")).alias("agreement_rate"),
        F.avg(diff).alias("mean_probability_diff"),
        F.max(diff).alias("max_probability_diff"))


def test_data_info(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Rows, feature count, positive rate and per-class counts of a test set."""
    y = F.col(label).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(len(features)).alias("n_features"),
                  F.avg(y.cast("double")).alias("fraud_rate"),
                  F.count_if(y == 0).alias("class_0"), F.count_if(y == 1).alias("class_1"))
