"""Data quality, projections and request handling.

Profiling reads the data once: a ``groupBy(all columns).count()`` (partial
aggregation combines duplicates map-side, so a hot duplicate group costs one
row per task) feeds row count, missing counts and duplicate count together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from calibra.functions.columns import missing

# Validation messages.
MSG_EMPTY = "DataFrame is empty"
MSG_MISSING_COLUMNS = "Missing required columns: {}"
MSG_MISSING_VALUES = "Found {} missing values"
MSG_TARGET_TYPE = "Target column '{}' is not numeric"
MSG_DUPLICATES = "Found {} duplicate rows"

# Confidence bands of a fraud probability.
LOW, MEDIUM, HIGH = "low", "medium", "high"


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns that exist (no-op otherwise)."""
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns of the schema (no job)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def split_features(df: DataFrame, label: str, keys: Sequence[str] = (), drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(X, y): ``keys`` with all columns but the label and ``drop``, and ``keys`` with the label.

    Both are projections of one scan; the keys join them again.  A missing label column is an error.
    """
    if label not in df.columns:
        raise ValueError(f"Target column {label!r} not found")
    left_out = {label, *drop}
    return (df.select(*keys, *[c for c in df.columns if c not in left_out and c not in keys]), df.select(*keys, label))


def _is_missing(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    return missing(c) if isinstance(t, (DoubleType, FloatType)) else F.col(c).isNull()


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """V3: ``(column_name, missing_count)`` for every column, one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "missing_count")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """V5: rows beyond the first of every group of identical rows (NaN = NaN)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                 F.count_if(F.col("_c") > 1).alias("duplicate_groups"))


def validation_summary(df: DataFrame, required: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """V1-V6: one-row report ``rows, columns, total_missing, duplicates, is_valid, issues``.

    Missing required columns are a schema check (no job); everything else
    comes from one aggregation over the distinct-row table.
    """
    cols = df.columns
    missing_cols = [c for c in required if c not in cols]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    miss = sum((F.when(_is_missing(df, c), F.col("_c")).otherwise(F.lit(0)) for c in cols), F.lit(0))
    s = g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("rows"),
              F.coalesce(F.sum(miss), F.lit(0)).cast("bigint").alias("total_missing"),
              F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
    rows, tm, dup = F.col("rows"), F.col("total_missing"), F.col("duplicates")
    target_bad = (target is not None and target in cols
                  and not isinstance(df.schema[target].dataType, NumericType))
    issues = F.when(rows == 0, F.array(F.lit(MSG_EMPTY)))
    if missing_cols:
        issues = issues.otherwise(F.array(F.lit(MSG_MISSING_COLUMNS.format(missing_cols))))
    else:
        parts = [F.when(tm > 0, F.format_string(MSG_MISSING_VALUES.replace("{}", "%d"), tm))]
        if target_bad:
            parts.append(F.lit(MSG_TARGET_TYPE.format(target)))
        parts.append(F.when(dup > 0, F.format_string(MSG_DUPLICATES.replace("{}", "%d"), dup)))
        issues = issues.otherwise(F.array_compact(F.array(*parts)))
    return s.select(rows, F.lit(len(cols)).alias("columns"), tm, dup,
                    ((rows > 0) & F.lit(not missing_cols)).alias("is_valid"), issues.alias("issues"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """V9: count and share per class.

    The share is a window over the per-class table (one row per class), not
    over the data.
    """
    g = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def missing_features(features: str | Column, required: Sequence[str]) -> Column:
    """Required feature names absent from a ``map<string,double>`` column."""
    m = F.col(features) if isinstance(features, str) else features
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(m))


def fill_features(features: str | Column, order: Sequence[str], default: float = 0.0) -> list[Column]:
    """P5: one column per feature in fixed order; absent -> ``default``."""
    m = F.col(features) if isinstance(features, str) else features
    return [F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default)).alias(k) for k in order]


def confidence_band(p: str | Column, low: float = 0.3, high: float = 0.7, closed: str = "left") -> Column:
    """``low/medium/high``.  ``closed="left"``: p<0.3 low, p<0.7 medium;
    ``closed="right"``: p>0.7 high, p>0.3 medium (the two rules differ at 0.3/0.7)."""
    p = F.col(p) if isinstance(p, str) else p
    if closed == "left":
        return F.when(p < low, LOW).when(p < high, MEDIUM).otherwise(HIGH)
    return F.when(p > high, HIGH).when(p > low, MEDIUM).otherwise(LOW)


def risk_score(p: str | Column) -> Column:
    """Probability as a 0-100 score."""
    p = F.col(p) if isinstance(p, str) else p
    return p * 100.0


def decide(score: str | Column, threshold: float = 0.5) -> Column:
    """Decision threshold."""
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(threshold)).cast("int")


def validate_step(df: DataFrame, required: Sequence[str] = (), target: str | None = None,
                  on_invalid: str = "warn") -> tuple[DataFrame, DataFrame]:
    """V8: returns ``(df, report)``; with ``on_invalid="raise"`` an invalid frame raises."""
    report = validation_summary(df, required, target)
    if on_invalid == "raise":
        r = report.first()
        if not r["is_valid"]:
            raise ValueError("; ".join(r["issues"]))
    return df, report


def validate_legacy(df: DataFrame) -> DataFrame:
    """V7: the fixed 31-column transaction layout (Time, V1..V28, Amount, Class)."""
    from calibra.sources.files import TX_COLUMNS

    return validation_summary(df, required=TX_COLUMNS, target="Class")
