"""Drift and degradation.

Two-sample KS runs on all features at once: unpivot to ``(feature, value,
side)``, count per distinct value (ties and hot values collapse map-side) and
store these counts, then distributed running sums per feature over them.  The
raw data is read once; no sort of it, no collect, no single-partition window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.columns import kolmogorov_sf, missing, safe_div
from calibra.functions.prefix import cumulative_counts
from calibra.llm.scratch import stored


def long_values(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    """``(feature, value, side)`` with missing values dropped per feature."""
    lv = df.select(side, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [side], list(features), "feature", "value")
    return lv.where(~missing("value"))


def ks_two_sample(df: DataFrame, features: Sequence[str], side: str = "side",
                  reference: str = "reference", current: str = "current",
                  alpha: float = 0.05, buckets: int | None = None) -> DataFrame:
    """``feature, ks_statistic, p_value, drift_detected, n_reference, n_current``.

    D = max |F_ref(v) - F_cur(v)| over all distinct values v; p from the
    asymptotic Kolmogorov distribution with lambda = D sqrt(n m / (n + m)).
    The bucket bounds, the buckets and their totals are all worked out from the stored
    counts, so that the rows of ``df`` are read and unpivoted only once.
    """
    counts = stored(long_values(df, features, side).groupBy("feature", "value").agg(
        F.count_if(F.col(side) == reference).alias("ca"), F.count_if(F.col(side) == current).alias("cb")), "value-counts")
    cum = cumulative_counts(counts, ["feature"], "value", {"ca": F.sum("ca"), "cb": F.sum("cb")}, buckets=buckets)
    gap = F.abs(safe_div(F.col("cum_ca"), F.col("tot_ca")) - safe_div(F.col("cum_cb"), F.col("tot_cb")))
    per = cum.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"),
        F.first("tot_ca").cast("bigint").alias("n_reference"),
        F.first("tot_cb").cast("bigint").alias("n_current"))
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    lam = F.col("ks_statistic") * F.sqrt(F.try_divide(n * m, n + m))
    p = F.when((n > 0) & (m > 0), kolmogorov_sf(lam))
    return per.select("feature", "ks_statistic", p.alias("p_value"),
                      F.coalesce(p < alpha, F.lit(False)).alias("drift_detected"),
                      "n_reference", "n_current")


def drift_summary(ks: DataFrame) -> DataFrame:
    """D3: features tested, drifted, percentage (0 when none), any drift."""
    return ks.agg(
        F.count(F.lit(1)).alias("total_features_checked"),
        F.count_if("drift_detected").alias("features_with_drift"),
        F.coalesce(F.try_divide(F.count_if("drift_detected") * 100.0, F.count(F.lit(1)).cast("double")),
                   F.lit(0.0)).alias("drift_percentage"),
        (F.count_if("drift_detected") > 0).alias("drift_detected"))


def histogram(df: DataFrame, features: Sequence[str], side: str = "side", bins: int = 30) -> DataFrame:
    """Equal-width histogram per feature and side on the shared [min, max].

    The per-feature range is an aggregate (one row per feature) that is broadcast: a shuffled join
    would first send every row to the task of its feature, of which there are only a few.
    """
    lv = long_values(df, features, side)
    rng = lv.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    h = lv.join(F.broadcast(rng), "feature").groupBy("feature", F.col(side).alias("side"), b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return h.select("feature", "side", "bin", "count",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"))


def f1_degradation(current: DataFrame, baseline_f1: float, threshold: float = 0.05,
                   f1_col: str = "f1") -> DataFrame:
    """drop = baseline - current, percent of baseline, degraded if drop > threshold."""
    drop = F.lit(baseline_f1) - F.col(f1_col)
    return current.withColumns({
        "baseline_f1": F.lit(float(baseline_f1)),
        "f1_drop": drop,
        "degradation_percentage": drop / F.lit(float(baseline_f1)) * 100.0,
        "performance_degraded": drop > F.lit(threshold),
    })


def metric_degradation(current: DataFrame, baseline: Mapping[str, float],
                       threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """For each baseline metric present in ``current``: drop and flag."""
    present = [m for m in baseline if m in current.columns]
    long = current.select(*by, *present).unpivot(list(by), present, "metric", "current_value")
    base = F.create_map(*[x for m in present for x in (F.lit(m), F.lit(float(baseline[m])))])
    bv = F.element_at(base, F.col("metric"))
    return long.select(*by, "metric", bv.alias("baseline_value"), "current_value",
                       (bv - F.col("current_value")).alias("drop"),
                       ((bv - F.col("current_value")) > threshold).alias("degraded"))
