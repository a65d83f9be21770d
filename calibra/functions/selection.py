"""Order statistics by repeated narrowing over the scan.

To find the r-th smallest value nothing is sorted or shuffled by value: every pass
counts the values of the interval that holds it in a bounded number of cells (a
grouped count, combined in the map tasks), and the next pass looks into the one
cell where rank r falls.  Only cell counts travel.  All wanted ranks of all groups
or columns are narrowed by the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: cells per pass and interval
CELLS = 2048
#: an interval that holds at most so many values is fetched instead of narrowed
FETCHED = 2048

#: bits of the hash uniform that a pass decides
DIGITS = (11, 11, 10)


def _either(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def key_cuts(df: DataFrame, group: str, u: Column, keys: Sequence[str], wanted: dict) -> dict:
    """``{group: {rank: (u, *keys)}}``: the row of that rank by (u, keys) in its group.

    ``u`` is a whole number of 32 bits; ``wanted`` lists ranks (from 1) per group value.
    Three counting passes decide ``u``; only rows that share that very ``u`` are then
    ordered by their keys, as many as the rank needs.
    """
    rows = df.select(F.col(group).alias("g"), u.cast("long").alias("u"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    # open searches: (group, rank) -> (prefix of u found so far, rank inside it)
    open_ = {(g, r): (0, r) for g, ranks in wanted.items() for r in ranks}
    left = 32
    for bits in DIGITS:
        left -= bits
        prefixes: dict = {}
        for (g, _), (prefix, _) in open_.items():
            prefixes.setdefault(g, set()).add(prefix)
        if not prefixes:
            return {}
        inside = _either([(F.col("g") == F.lit(g)) & F.shiftright("u", left + bits).isin(sorted(p))
                          for g, p in prefixes.items()])
        counts: dict = {}
        for r in rows.where(inside).groupBy("g", F.shiftright("u", left).alias("cell")).agg(
                F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((r["g"], r["cell"] >> bits), []).append((r["cell"], r["n"]))
        for at, (prefix, rank) in open_.items():
            for cell, n in sorted(counts.get((at[0], prefix), [])):
                if rank <= n:
                    open_[at] = (cell, rank)
                    break
                rank -= n
            else:
                raise ValueError(f"class {at[0]!r} has fewer than {at[1]} rows")
    need: dict = {}
    for (g, _), (value, rank) in open_.items():
        need[g, value] = max(need.get((g, value), 0), rank)
    names = [f"k{i}" for i in range(len(keys))]
    # few rows share one u; repeated keys are counted, and no more keys are fetched than the rank needs
    tied = rows.where(_either([(F.col("g") == F.lit(g)) & (F.col("u") == v) for g, v in need]))
    first = Window.partitionBy("g", "u").orderBy(*names)
    order = tied.groupBy("g", "u", *names).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= max(need.values())).orderBy("g", "u", "place")
    found: dict = {}
    for r in order.collect():
        found.setdefault((r["g"], r["u"]), []).append((tuple(r[x] for x in names), r["n"]))
    out: dict = {}
    for (g, wanted_rank), (value, rank) in open_.items():
        for key, n in found[g, value]:
            if rank <= n:
                out.setdefault(g, {})[wanted_rank] = (value, *key)
                break
            rank -= n
    return out


def beyond(df: DataFrame, u: Column, keys: Sequence[str], cut: tuple | None) -> Column:
    """Whether a row comes after ``cut`` by (u, keys); after nothing (None) every row does."""
    if cut is None:
        return F.lit(True)
    after, same = F.lit(False), F.lit(True)
    for column, value, kind in zip([u.cast("long"), *[F.col(k) for k in keys]], cut,
                                   ["long", *[df.schema[k].dataType for k in keys]], strict=True):
        v = F.lit(value).cast(kind)
        # nulls come first, as in an ascending sort
        greater = column.isNotNull() if value is None else column.isNotNull() & (column > v)
        after, same = after | (same & greater), same & column.eqNullSafe(v)
    return F.coalesce(after, F.lit(False))


def _scale(x: Column) -> Column:
    """A monotone image in which values of all magnitudes spread: sign(x) log(1 + |x|), infinities near them."""
    return F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.signum(x) * F.log1p(F.abs(x))))


class _Interval:
    """Where one column's wanted rank lies: values of [low, high], of which it is the rank-th."""

    def __init__(self, column: str, rank: int, low: float, high: float, n: int):
        self.column, self.rank, self.low, self.high, self.n = column, rank, low, high, n


def order_statistics(df: DataFrame, wanted: dict[str, Sequence], missing=None) -> tuple[dict, dict]:
    """({column: {p: (lower, upper, fraction)}}, {column: missing values}) for the R-7 quantiles p.

    ``lower`` and ``upper`` are the order statistics on either side of the quantile's place.  NULL
    and NaN are left out and counted; a column without values has no entry.
    """
    absent = missing or (lambda c: F.col(c).isNull() | F.isnan(c))
    cols = list(wanted)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    # one pass: number of values and their range
    row = values.agg(*[F.count_if(~absent(c)).alias(f"n|{c}") for c in cols], *[F.count_if(absent(c)).alias(f"m|{c}") for c in cols],
                     *[F.min(F.when(~absent(c), F.col(c))).alias(f"lo|{c}") for c in cols],
                     *[F.max(F.when(~absent(c), F.col(c))).alias(f"hi|{c}") for c in cols]).first()
    places, found, open_ = {}, {}, []
    for c in cols:
        n = row[f"n|{c}"]
        for p in wanted[c] if n else ():
            at = (n - 1) * float(p)
            places[c, p] = (math.floor(at) + 1, math.ceil(at) + 1, at - math.floor(at))
        for rank in {r for (x, _), place in places.items() if x == c for r in place[:2]}:
            open_.append((rank, _Interval(c, rank, row[f"lo|{c}"], row[f"hi|{c}"], n)))

    def cell(interval: _Interval) -> Column:
        x, low, high = F.col(interval.column), F.lit(interval.low), F.lit(interval.high)
        share = F.try_divide(_scale(x) - _scale(low), _scale(high) - _scale(low))
        # the interval's ends have cells of their own, so that every pass narrows
        inner = F.greatest(F.lit(1), F.least(F.lit(CELLS), (share * CELLS).cast("int") + 1))
        return F.when(x == low, 0).when(x == high, CELLS + 1).otherwise(F.coalesce(inner, F.lit(1)))

    while True:
        for rank, i in [o for o in open_ if o[1].low == o[1].high]:
            found[i.column, rank] = i.low
        open_ = [o for o in open_ if o[1].low != o[1].high]
        if not open_:
            break
        spans = sorted({(i.column, i.low, i.high, i.n) for _, i in open_})
        small = [s for s in spans if s[3] <= FETCHED]
        wide = [s for s in spans if s[3] > FETCHED]

        def entries(chosen, what):
            return F.filter(F.array(*[
                F.when(F.col(c).between(lo, hi), F.struct(F.lit(k).alias("k"), F.col(c).alias("x"), *what(c, lo, hi)))
                for k, (c, lo, hi, _) in enumerate(chosen)]), lambda e: e.isNotNull())

        if small:
            held: dict = {}
            for r in values.select(F.explode(entries(small, lambda c, lo, hi: [])).alias("e")).select("e.*").collect():
                held.setdefault(small[r["k"]], []).append(r["x"])
            for rank, i in open_:
                span = (i.column, i.low, i.high, i.n)
                if span in held:
                    found[i.column, rank] = sorted(held[span])[i.rank - 1]
        cells: dict = {}
        if wide:
            for r in values.select(F.explode(entries(
                    wide, lambda c, lo, hi: [cell(_Interval(c, 0, lo, hi, 0)).alias("cell")])).alias("e")).groupBy("e.k", "e.cell").agg(
                    F.count(F.lit(1)).alias("n"), F.min("e.x").alias("low"), F.max("e.x").alias("high")).collect():
                cells.setdefault(wide[r["k"]], []).append((r["cell"], r["n"], r["low"], r["high"]))
        narrowed = []
        for rank, i in open_:
            span, below = (i.column, i.low, i.high, i.n), 0
            for _, n, low, high in sorted(cells.get(span, [])):
                if i.rank <= below + n:
                    narrowed.append((rank, _Interval(i.column, i.rank - below, low, high, n)))
                    break
                below += n
        open_ = narrowed
    out: dict = {}
    for (c, p), (lower, upper, fraction) in places.items():
        out.setdefault(c, {})[p] = (found[c, lower], found[c, upper], fraction)
    return out, {c: row[f"m|{c}"] for c in cols}
