"""Distributed running sums over a sorted value inside each group.

A plain ``Window.partitionBy(g).orderBy(v)`` puts a whole group in one task;
with one group (a single feature, a single model) that is the whole table in
one task.  Instead:

1. per group, approximate quantile bounds split the value range into at most
   ``MAX_BOUNDS`` parts, and each part into equally wide cells: together ``B`` buckets
   (equal values always land in the same bucket).  The bounds are compared by a few
   nested CASEs whose number does not grow with the cluster, the cells are arithmetic;
2. per (group, bucket) totals -> exclusive running sum over the *tiny*
   bucket table gives each bucket its offset;
3. the running sum inside each (group, bucket) window plus the offset is the
   exact running sum.

Parallelism is groups x B.  The bounds are broadcast behind a count of
the groups, so raw rows are never shuffled by their group alone; the offsets
table (groups x B rows) is an equi-join that AQE broadcasts when it is small.
Without group columns the bounds (B-1 numbers) and offsets (B numbers) are
fetched as literals, so the plan has no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.frames import few_rows

#: up to so many groups the bucket bounds are fetched and broadcast; beyond, they are joined
MAX_SHIPPED_GROUPS = 10_000


#: quantile bounds per group, and buckets per group in all
MAX_BOUNDS, MAX_BUCKETS = 64, 4096


def bucket_count(df: DataFrame, buckets: int | None) -> tuple[int, int]:
    """(parts by quantile bounds, cells in each): together the asked-for number of buckets, or as
    many as there are shuffle partitions (32 at least)."""
    wanted = max(1, int(buckets)) if buckets else max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(wanted, MAX_BOUNDS)
    return parts, -(-min(wanted, MAX_BUCKETS) // parts)


def _points(value_col: str, parts: int, accuracy: int) -> F.Column:
    """Least value, the bounds between parts, greatest value."""
    return F.percentile_approx(F.col(value_col), [i / parts for i in range(parts + 1)], accuracy)


def _with_bounds(df: DataFrame, group_cols: Sequence[str], value_col: str, parts: int, accuracy: int) -> DataFrame:
    """``df`` with its group's ``_bounds``.  The bounds are sketched with map-side
    combination; while the groups are few (counted, not guessed) they are broadcast, so
    the rows of ``df`` are not shuffled by their group."""
    bounds = df.groupBy(*group_cols).agg(_points(value_col, parts, accuracy).alias("_bounds"))
    found = bounds.limit(MAX_SHIPPED_GROUPS + 1).collect()
    if len(found) > MAX_SHIPPED_GROUPS:
        return df.join(bounds, list(group_cols), "left")
    small = few_rows(df.sparkSession, found, bounds.schema)
    # null groups keep their rows: the join is null-safe
    names = [f"_g{i}" for i in range(len(group_cols))]
    small = small.select(*[F.col(c).alias(n) for c, n in zip(group_cols, names, strict=True)], "_bounds")
    same = [df[c].eqNullSafe(small[n]) for c, n in zip(group_cols, names, strict=True)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(F.broadcast(small), on, "left").drop(*names)


def _with_bucket(df: DataFrame, value_col: str, points: F.Column, parts: int, cells: int) -> DataFrame:
    """``df`` with ``_bucket``, which does not decrease with the value.

    The part is the number of inner points strictly below the value, by a binary search of nested
    CASEs inside generated code (a lambda over the array would be interpreted and ~5x
    slower); the cell is where the value lies between the part's two points.
    """
    v = F.col(value_col)

    def search(lo: int, hi: int) -> F.Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(points[mid + 1] < v, search(mid + 1, hi)).otherwise(search(lo, mid))

    numbered = df.withColumn("_part", search(0, parts - 1))
    numeric = isinstance(df.schema[value_col].dataType, T.NumericType)
    if cells == 1 or not numeric:
        return numbered.withColumnRenamed("_part", "_bucket")
    low, high = points[F.col("_part")].cast("double"), points[F.col("_part") + 1].cast("double")
    share = F.try_divide(v.cast("double") - low, high - low)
    cell = F.when(share >= 1, cells - 1).when(share > 0, F.floor(share * cells)).otherwise(0)
    return numbered.withColumn("_bucket", F.col("_part") * cells + F.least(F.lit(cells - 1), cell.cast("int"))).drop("_part")


def with_buckets(df: DataFrame, group_cols: Sequence[str], value_col: str, buckets: int | None = None,
                 accuracy: int = 10000) -> DataFrame:
    """``df`` with ``_bucket``: about equally many rows of a group each, in the order of the value."""
    parts, cells = bucket_count(df, buckets)
    if parts == 1:
        return df.withColumn("_bucket", F.lit(0))
    if not group_cols:
        return _bucketed(df, value_col, buckets, accuracy)[0]
    bounded = _with_bounds(df, list(group_cols), value_col, parts, accuracy)
    return _with_bucket(bounded, value_col, F.col("_bounds"), parts, cells).drop("_bounds")


def running_sums(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 count_cols: Sequence[str], buckets: int | None = None,
                 accuracy: int = 10000, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` (sum of c over rows with value <= this value, same group)
    and ``tot_<c>`` (group total) for every ``c`` in ``count_cols``.

    ``df`` should already hold one row per (group, value): aggregate counts
    first so ties collapse and the result is tie-exact.  Alternatively give
    ``tiebreak`` columns that make (value, tiebreak) unique: rows with equal
    values always share a bucket, so ordering the bucket window by
    (value, tiebreak) yields a strict total order (a distributed rank).  Used
    that way on raw rows, ``value`` should be (near) unique - a hash uniform or
    a key - since all rows of one value share a task; for data with heavy ties
    use :func:`cumulative_counts`, which combines ties before the shuffle.
    """
    group_cols = list(group_cols)
    if not group_cols:
        return _running_sums_global(df, value_col, count_cols, buckets, accuracy, tiebreak)
    parts, cells = bucket_count(df, buckets)
    if parts > 1:
        bounded = _with_bounds(df, group_cols, value_col, parts, accuracy)
        with_b = _with_bucket(bounded, value_col, F.col("_bounds"), parts, cells).drop("_bounds")
    else:
        with_b = df.withColumn("_bucket", F.lit(0))

    # one shuffle of the rows by (group, bucket): the per-bucket totals and the
    # bucket windows both read it (the totals aggregate needs no new exchange)
    dealt = with_b.repartition(*group_cols, "_bucket")
    per_bucket = dealt.groupBy(*group_cols, "_bucket").agg(
        *[F.sum(c).alias(f"_b_{c}") for c in count_cols])
    w_off = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    w_tot = Window.partitionBy(*group_cols)
    offsets = per_bucket.select(
        *group_cols, "_bucket",
        *[F.coalesce(F.sum(f"_b_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}") for c in count_cols],
        *[F.sum(f"_b_{c}").over(w_tot).alias(f"tot_{c}") for c in count_cols])

    # offsets has groups x B rows; AQE broadcasts it when small, otherwise the join
    # reuses the (group, bucket) partitioning of ``dealt``
    joined = dealt.join(offsets, [*group_cols, "_bucket"], "left")
    w_in = Window.partitionBy(*group_cols, "_bucket").orderBy(value_col, *tiebreak).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *[c for c in with_b.columns if c != "_bucket"],
        *[(F.sum(c).over(w_in) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in count_cols],
        *[F.col(f"tot_{c}") for c in count_cols])


def _bucketed(df: DataFrame, value_col: str, buckets: int | None, accuracy: int) -> tuple[DataFrame, int]:
    """``df`` as one group with ``_bucket``, and the number of buckets; the points are literals."""
    parts, cells = bucket_count(df, buckets)
    points = (df.agg(_points(value_col, parts, accuracy)).first()[0] or []) if parts > 1 else []
    if not points:
        return df.withColumn("_bucket", F.lit(0)), 1
    kind = df.schema[value_col].dataType
    return _with_bucket(df, value_col, F.array(*[F.lit(x).cast(kind) for x in points]), parts, cells), parts * cells


def _running_sums_global(df: DataFrame, value_col: str, count_cols: Sequence[str], buckets: int | None,
                         accuracy: int, tiebreak: Sequence[str]) -> DataFrame:
    """One group: bounds and bucket offsets are a few numbers, used as literals."""
    with_b, nb = _bucketed(df, value_col, buckets, accuracy)
    # at most nb rows: the per-bucket totals
    per = {r["_bucket"]: r for r in with_b.groupBy("_bucket").agg(
        *[F.sum(c).alias(c) for c in count_cols]).collect()}
    lits = []
    for c in count_cols:
        sizes = [(per[i][c] or 0) if i in per else 0 for i in range(nb)]
        offs = [0, *accumulate(sizes)][:nb]
        t = "bigint" if all(isinstance(x, int) for x in sizes) else "double"
        lits.append((c, F.array(*[F.lit(o).cast(t) for o in offs]), F.lit(sum(sizes)).cast(t)))
    w_in = Window.partitionBy("_bucket").orderBy(value_col, *tiebreak).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return with_b.select(
        *df.columns,
        *[(F.sum(c).over(w_in) + F.element_at(arr, F.col("_bucket") + 1)).alias(f"cum_{c}")
          for c, arr, _ in lits],
        *[total.alias(f"tot_{c}") for c, _, total in lits])


def cumulative_counts(raw: DataFrame, group_cols: Sequence[str], value_col: str,
                      aggs: dict, buckets: int | None = None, accuracy: int = 10000) -> DataFrame:
    """Per (group, distinct value): the aggregates ``aggs`` (name -> Column),
    their running sums ``cum_<name>`` over values <= this value and group
    totals ``tot_<name>`` - computed straight from the raw rows.

    The raw rows are only ever partially aggregated before a shuffle: the
    bucket bounds are per-partition quantile sketches, and the (group, bucket,
    value) counts are combined map-side, so a hot value costs one row per task.
    The count table is shuffled once for the aggregation; the per-bucket
    totals reuse that exchange.
    """
    group_cols = list(group_cols)
    names = list(aggs)
    if group_cols:
        parts, cells = bucket_count(raw, buckets)
        rb = _with_bucket(_with_bounds(raw, group_cols, value_col, parts, accuracy), value_col, F.col("_bounds"), parts,
                          cells).drop("_bounds") if parts > 1 else raw.withColumn("_bucket", F.lit(0))
    else:
        rb, _ = _bucketed(raw, value_col, buckets, accuracy)
    counts = rb.groupBy(*group_cols, "_bucket", value_col).agg(*[a.alias(n) for n, a in aggs.items()])
    per_bucket = counts.groupBy(*group_cols, "_bucket").agg(*[F.sum(n).alias(f"_b_{n}") for n in names])
    keys = group_cols or []
    w_off = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_tot = Window.partitionBy(*keys)
    # per_bucket has groups x B rows; without groups the window runs over B rows
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_b_{n}").over(w_off), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_b_{n}").over(w_tot).alias(f"tot_{n}") for n in names])
    joined = counts.join(offsets, [*keys, "_bucket"], "left")
    w_in = Window.partitionBy(*keys, "_bucket").orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *keys, value_col, *names,
        *[(F.sum(n).over(w_in) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[F.col(f"tot_{n}") for n in names])
