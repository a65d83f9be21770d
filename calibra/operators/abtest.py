"""A/B testing.

Routing is a hash of (test id, key), so an entity always lands in the same arm,
independent of partitioning, retries and engine.  Sequential batches use a
distributed rank (prefix sums) instead of a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.columns import norm_two_sided_p, safe_div, u01
from calibra.functions.prefix import running_sums
from calibra.operators import metrics as M
from calibra.session import cut_lineage

AB_METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def route(key: str | Column, test_id: str = "ab", split: float = 0.5) -> Column:
    """``'B'`` when u(test_id, key) < split else ``'A'`` (sticky)."""
    return F.when(u01(test_id, key) < F.lit(split), "B").otherwise("A")


def routed(df: DataFrame, arm: Column, label: str, pred_a: str, pred_b: str,
           score_a: str, score_b: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per request with the routed arm's prediction and probability."""
    return df.select(
        *keep, arm.alias("arm"), F.col(label).alias("y_true"),
        F.when(arm == "B", F.col(pred_b)).otherwise(F.col(pred_a)).alias("y_pred"),
        F.when(arm == "B", F.col(score_b)).otherwise(F.col(score_a)).alias("score"))


def arm_metrics(r: DataFrame, buckets: int | None = None) -> DataFrame:
    """A1: metrics per arm: accuracy, precision, recall, f1_score, roc_auc, confusion, size.

    Both arms always have a row; an arm without requests has zeros and an AUC of 0.5.
    """
    s = M.evaluation_summary(r, "y_true", "y_pred", "score", ["arm"], buckets)
    found = s.select("arm", "accuracy", "precision", "recall", F.col("f1").alias("f1_score"), "roc_auc",
                     "tn", "fp", "fn", "tp", F.col("n").alias("sample_size"))
    arms = r.sparkSession.createDataFrame([("A",), ("B",)], "arm string")
    empty = {"roc_auc": 0.5}
    return arms.join(found, "arm", "left").select("arm", *[
        F.coalesce(F.col(c), F.lit(empty.get(c, 0)).cast(found.schema[c].dataType)).alias(c) for c in found.columns[1:]])


def _pivot_arms(am: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("arm") == "A", F.col(c))).alias(f"{c}_a"))
        aggs.append(F.max(F.when(F.col("arm") == "B", F.col(c))).alias(f"{c}_b"))
    return am.agg(*aggs)


def compare_arms(am: DataFrame) -> DataFrame:
    """A2: % change B vs A per metric (0 when A is 0); winner by the largest |change|.

    Ties keep the earlier metric; winner is NULL when every change is 0.
    """
    w = _pivot_arms(am, AB_METRICS)
    imps = {}
    for m in AB_METRICS:
        a, b = F.col(f"{m}_a"), F.col(f"{m}_b")
        imps[m] = F.when(a != 0, (b - a) / a * 100.0).otherwise(F.lit(0.0))
    best = F.greatest(*[F.struct(F.abs(imps[m]).alias("mag"), F.lit(-i).alias("ord"), imps[m].alias("imp"))
                        for i, m in enumerate(AB_METRICS)])
    out = w.select(*[imps[m].alias(f"{m}_improvement") for m in AB_METRICS], best.alias("_best"))
    return out.select(
        *[f"{m}_improvement" for m in AB_METRICS],
        F.when(F.col("_best.mag") > 0, F.when(F.col("_best.imp") > 0, "B").otherwise("A")).alias("winner"),
        F.when(F.col("_best.mag") > 0, F.col("_best.imp")).otherwise(F.lit(0.0)).alias("max_improvement"))


def significance(am: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A3: z = (F1_B - F1_A) / sqrt(sum f(1-f)/n), two-sided normal p.

    se = 0 gives z = 0; an empty arm gives NULL (there is nothing to divide by).
    """
    w = _pivot_arms(am, ["f1_score", "sample_size"])
    fa, fb = F.col("f1_score_a"), F.col("f1_score_b")
    na, nb = F.col("sample_size_a"), F.col("sample_size_b")
    se = F.sqrt(F.try_divide(fa * (1 - fa), na.cast("double")) + F.try_divide(fb * (1 - fb), nb.cast("double")))
    z = F.when(se > 0, (fb - fa) / se).when(se == 0, F.lit(0.0))
    p = norm_two_sided_p(z)
    return w.select(fa.alias("f1_a"), fb.alias("f1_b"), na.alias("n_a"), nb.alias("n_b"),
                    z.alias("t_statistic"), p.alias("p_value"), (p < alpha).alias("significant"))


def simple_decision(r: DataFrame) -> DataFrame:
    """A4: per-arm positive-class F1; winner Tie/A/B, improvement %, significant if > 2 %."""
    am = M.binary_metrics(r, "y_true", "y_pred", ["arm"]).withColumnRenamed("f1", "f1_score")
    w = _pivot_arms(am, ["f1_score", "n"])
    fa, fb = F.col("f1_score_a"), F.col("f1_score_b")
    inf = F.lit(float("inf"))
    imp = (F.when((fa == 0) & (fb == 0), F.lit(0.0))
           .when(fa == 0, F.when(fb > 0, inf).otherwise(F.lit(0.0)))
           .otherwise((fb - fa) / fa * 100.0))
    winner = (F.when((fa == 0) & (fb == 0), "Tie")
              .when(fa == 0, F.when(fb > 0, "B").otherwise("Tie"))
              .otherwise(F.when(fb > fa, "B").otherwise("A")))
    return w.select(F.col("n_a").alias("group_a_count"), F.col("n_b").alias("group_b_count"),
                    fa.alias("f1_a"), fb.alias("f1_b"), imp.alias("f1_improvement"), winner.alias("winner"),
                    F.when(imp == inf, F.lit(True)).otherwise(F.abs(imp) > 2.0).alias("significant"))


def _batches(r: DataFrame, order_key: str, batch_size: int, buckets: int | None) -> DataFrame:
    """Samples and per-arm sums of every batch, one row each; rank and sums are distributed."""
    ranked = running_sums(r.withColumn("_one", F.lit(1)), [], order_key, ["_one"], buckets=buckets)
    batch = F.floor((F.col("cum__one") - 1) / F.lit(batch_size)).cast("bigint") + 1
    correct = (F.col("y_true") == F.col("y_pred")).cast("int")
    return ranked.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.when(F.col("arm") == "A", correct).otherwise(0)).cast("bigint").alias("a_correct"),
        F.sum(F.when(F.col("arm") == "B", correct).otherwise(0)).cast("bigint").alias("b_correct"),
        F.count_if(F.col("arm") == "A").alias("a_n"),
        F.count_if(F.col("arm") == "B").alias("b_n"))


def sequential_batches(r: DataFrame, order_key: str, batch_size: int = 100,
                       min_samples: int = 1000, confidence: float = 0.95,
                       buckets: int | None = None, report: dict | None = None) -> DataFrame:
    """A5: cumulative correct/total per arm after each batch of ``batch_size`` rows
    in ``order_key`` order (unique numeric key), with z/p once both arms reach
    ``min_samples``.

    Early stopping saves the work: the batches are those of the rows below a cut of
    the key, and the cut moves up the key's quantiles, doubling the rows, until a batch is
    significant or the table is exhausted.  Which quantile sketch places the cuts does not matter, since
    the rows below a cut are ranked exactly and a last, incomplete batch is left out.
    Batches after the first significant one are not all there.  ``report`` receives
    the rows of the table and those that were ranked.
    """
    halves = [2.0 ** -i for i in range(40, 0, -1)]
    total, at = r.agg(F.count(F.lit(1)), F.percentile_approx(order_key, halves, 10000)).first()
    least = max(4 * min_samples, 20 * batch_size)
    cuts = [x for share, x in zip(halves, at or [], strict=False) if least <= share * total]
    for cut in [*sorted(set(cuts)), None]:
        part = r if cut is None else r.where(F.col(order_key) <= F.lit(cut))
        # one row per batch of rows: small, and reused by every later step -> cut the lineage here
        per = cut_lineage(_batches(part, order_key, batch_size, buckets))
        if cut is not None:
            per = per.where(F.col("samples") == batch_size)
        out = _judged_batches(per, min_samples, confidence, buckets)
        if report is not None:
            report.update(table=total, ranked=report.get("ranked", 0) + (total if cut is None else part.count()))
        if cut is None or not out.where("significant").isEmpty():
            return out
    raise AssertionError("unreachable")


def _judged_batches(per: DataFrame, min_samples: int, confidence: float, buckets: int | None) -> DataFrame:
    """Running rates, z and p after every batch."""
    cum = running_sums(per, [], "batch", ["a_correct", "b_correct", "a_n", "b_n"], buckets=buckets)
    ta, tb = F.col("cum_a_n"), F.col("cum_b_n")
    ra = safe_div(F.col("cum_a_correct"), ta)
    rb = safe_div(F.col("cum_b_correct"), tb)
    out = cum.select("batch", "samples", ra.alias("rate_a"), rb.alias("rate_b"),
                     ta.alias("total_a"), tb.alias("total_b"))
    ra, rb = F.col("rate_a"), F.col("rate_b")
    ta, tb = F.col("total_a"), F.col("total_b")
    se = F.sqrt(F.try_divide(ra * (1 - ra), ta.cast("double")) + F.try_divide(rb * (1 - rb), tb.cast("double")))
    eligible = (ta >= min_samples) & (tb >= min_samples)
    z = F.when(eligible, F.when(se > 0, (rb - ra) / se).otherwise(F.lit(0.0)))
    p = norm_two_sided_p(z)
    out = out.withColumns({
        "improvement": F.when(ra > 0, (rb - ra) / ra * 100.0).otherwise(F.lit(0.0)),
        "z_score": z, "p_value": p,
        "significant": F.coalesce(p < F.lit(1.0 - confidence), F.lit(False)),
    })
    return out


def sequential_result(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the batch table at the first significant batch; one-row decision.

    Returns ``(kept_batches, decision)``.  The stop batch is one number (an
    aggregate fetched to the driver), applied as a filter literal.
    """
    row = batches.agg(F.min(F.when(F.col("significant"), F.col("batch"))).alias("stop"),
                      F.max("batch").alias("last")).first()
    stop = row["stop"] if row["stop"] is not None else row["last"]
    kept = batches.where(F.col("batch") <= F.lit(stop if stop is not None else 0))
    decision = kept.agg(
        F.max("batch").alias("batches_run"),
        F.max(F.col("significant").cast("int")).cast("boolean").alias("early_stopped"),
        F.max_by(F.when(F.col("rate_b") > F.col("rate_a"), "B").otherwise("A"), F.col("batch")).alias(
            "final_decision"))
    return kept, decision


def result_log(one_row: DataFrame, metric_cols: list[str], param_cols: list[str] = (),
               experiment: str = "ab_testing") -> DataFrame:
    """One run-log row: finite numbers -> ``metrics``; NaN/inf numbers and
    the other values -> ``params`` (as strings)."""
    finite = {c: F.col(c).cast("double") for c in metric_cols}
    ok = {c: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for c, v in finite.items()}
    metrics = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(c).alias("key"), finite[c].alias("value")) for c in metric_cols]),
        lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) != float("inf"))))
    bad = [F.when(~ok[c], F.struct(F.lit(c).alias("key"), finite[c].cast("string").alias("value")))
           for c in metric_cols]
    other = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in param_cols]
    params = F.map_from_entries(F.filter(F.array(*bad, *other), lambda e: e.isNotNull()))
    return one_row.select(F.lit(experiment).alias("experiment"), metrics.alias("metrics"),
                          params.alias("params"))
