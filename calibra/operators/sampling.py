"""Exact stratified splits, k-fold assignment and class rebalancing.

Splits are exact and reproducible: every row gets a uniform number
``u = md5(seed, key)``, and inside each class the rows are ordered by ``(u, key)``.
The quotas come from the class-count table (one row per class); the rows at which
a quota ends are found by counting passes over the scan
(:mod:`calibra.functions.selection`), and the split itself is a projection that
compares each row with those cuts.  No row is shuffled.  The same key always lands
in the same split, whatever the partitioning or retry; rows of one key stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.columns import TWO_POW_32, u01
from calibra.functions.selection import beyond, key_cuts


def row_uniform(keys: Sequence[str], seed: str) -> Column:
    """u in [0,1) from the row key (several columns joined with '|')."""
    return u01(seed, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def row_u32(keys: Sequence[str], seed: str) -> Column:
    """``row_uniform`` as the whole number it is made of (32 bits)."""
    return (row_uniform(keys, seed) * TWO_POW_32).cast("long")


def after_cuts(df: DataFrame, label: str, keys: Sequence[str], u: Column, ends: dict) -> Column:
    """How many of its class's cuts a row lies beyond; its ``_u`` is ``u``.

    ``ends``: per class the ranks at which its parts end, ascending; a part that ends
    at rank 0 is empty.  Rows of classes that are not listed lie beyond none.
    """
    known = {c: ranks for c, ranks in ends.items() if c is not None}
    cuts = key_cuts(df, label, u, keys, {c: sorted({r for r in ranks if r > 0}) for c, ranks in known.items()})
    out = F.lit(0)
    for c, ranks in known.items():
        passed = F.lit(0)
        for r in ranks:
            passed = passed + beyond(df, F.col("_u"), keys, cuts[c][r] if r > 0 else None).cast("int")
        out = F.when(F.col(label) == F.lit(c), passed).otherwise(out)
    return out


def _with_part(df: DataFrame, label: str, keys: Sequence[str], seed: str, ends: dict, name: str, part,
               u: str | None = None) -> DataFrame:
    """``df`` with ``name`` made of the number of cuts that a row lies beyond.

    ``u`` names a column that holds ``row_u32`` of the keys and seed already: the comparisons are
    inlined into filters, where the hash would be worked out anew for every one of them.
    """
    mark = F.col(u) if u else row_u32(keys, seed)
    passed = after_cuts(df, label, keys, mark, ends)
    return df.withColumn("_u", mark).withColumn(name, part(passed)).drop("_u")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class (one row per class reaches the driver)."""
    return {r[0]: int(r[1]) for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}


def class_quotas(counts: dict, frac: float) -> dict:
    """Per-class sizes of a ``frac`` share: total ceil(frac * N), floors first,
    the remainder to the classes with the largest fractional parts (label breaks ties)."""
    fl = {c: math.floor(frac * n) for c, n in counts.items()}
    rem = math.ceil(frac * sum(counts.values())) - sum(fl.values())
    order = sorted(counts, key=lambda c: (-(frac * counts[c] - fl[c]), c))
    for c in order[:max(0, rem)]:
        fl[c] += 1
    return fl


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2,
                     seed: str = "split42", u: str | None = None) -> DataFrame:
    """Adds ``split`` = 'test' for the first quota rows of every class, else 'train'."""
    q = class_quotas(class_counts(df, label), test_size)
    listed = F.col(label).isin([c for c in q if c is not None])
    return _with_part(df, label, keys, seed, {c: [n] for c, n in q.items()}, "split",
                      lambda passed: F.when(listed & (passed == 0), "test").otherwise("train"), u)


def val_fraction(val_size: float, test_size: float) -> float:
    """R2: validation share of what is left after the test split."""
    return val_size / (1.0 - test_size)


def three_way_split(df: DataFrame, label: str, keys: Sequence[str], val_size: float = 0.2,
                    test_size: float = 0.2, seed: str = "split42") -> DataFrame:
    """R2: test quota first, then the validation quota of the remainder, stratified both times."""
    counts = class_counts(df, label)
    tq = class_quotas(counts, test_size)
    vq = class_quotas({c: n - tq[c] for c, n in counts.items()}, val_fraction(val_size, test_size))
    ends = {c: [tq[c], tq[c] + vq[c]] for c in counts}
    listed = F.col(label).isin([c for c in counts if c is not None])
    return _with_part(df, label, keys, seed, ends, "split", lambda passed: F.when(listed & (passed == 0), "test").when(
        listed & (passed == 1), "val").otherwise("train"))


def fold_assignment(df: DataFrame, label: str, keys: Sequence[str], k: int = 5,
                    seed: str = "split42", u: str | None = None) -> DataFrame:
    """Stratified ``fold`` in 0..k-1; per class the first n % k folds hold one extra row."""
    ends = {}
    for c, n in class_counts(df, label).items():
        sizes = [n // k + (i < n % k) for i in range(k)]
        ends[c] = list(accumulate(sizes))[:-1]
    return _with_part(df, label, keys, seed, ends, "fold", lambda passed: passed, u)


def sampling_info(before: DataFrame, after: DataFrame, label: str, method: str) -> DataFrame:
    """Counts per class before/after a resampling and rows added."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    j = b.join(a, label, "full_outer")
    return j.select(F.lit(method).alias("method"), label,
                    F.coalesce("n_before", F.lit(0)).alias("n_before"),
                    F.coalesce("n_after", F.lit(0)).alias("n_after"),
                    (F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))).alias("added"))
