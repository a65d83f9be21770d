"""Exact dedup (operator 9): a heavy-hitter split of the digests.

1. Misra-Gries summaries, one per task and merged by summing, name at most
   ``k`` digests that can make up more than ``1/(k+1)`` of the rows.
2. One aggregation verifies them: exact group size and winning id of each of
   those digests.  At most ``k`` rows result, so they may be broadcast.
3. Rows of a verified digest that are not its winner are decided map-side and
   never shuffled.  All other rows go through one ordinary shuffle on the digest;
   no group there holds more than about ``2n/(k+1)`` rows.

Defined results.  A null text counts as the empty text.  The largest id of a
group wins; null ids lose against any other.  If the winning id occurs on
several rows (repeated rows), exactly one of them is kept.  If all ids of a
group are null, one row is kept and ``keep_id`` is null.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.frames import few_rows
from calibra.llm.scratch import free_name, stored

HEAVY = 256
#: up to here the ids of the copies that go are broadcast
BROADCAST_BYTES = 32 << 20


def misra_gries(batches: Iterator[np.ndarray], k: int) -> dict:
    """At most ``k`` counters; a value with more than n/(k+1) of the n rows keeps one.

    Each batch is first reduced to (value, count); when there are more than
    ``k`` counters, the (k+1)-th largest count is taken from all of them, which
    is the merge rule for such summaries.
    """
    counters: dict = {}
    for batch in batches:
        values, counts = np.unique(batch, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            counters[v] = counters.get(v, 0) + c
        counters = _shrink(counters, k)
    return counters


def _shrink(counters: dict, k: int) -> dict:
    if len(counters) <= k:
        return counters
    cut = sorted(counters.values(), reverse=True)[k]
    return {v: c - cut for v, c in counters.items() if c > cut}


def frequent(digests: DataFrame, column: str, k: int = HEAVY) -> DataFrame:
    """At most ``k`` values of ``column`` (binary) with lower bounds of their counts."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (b.column(0).to_numpy(zero_copy_only=False) for b in batches)
        found = misra_gries((a for a in arrays if len(a)), k)
        yield pa.RecordBatch.from_pydict(
            {"value": pa.array(list(found), pa.binary()), "bound": pa.array(list(found.values()), pa.int64())})

    per_task = digests.select(column).where(F.col(column).isNotNull()).mapInArrow(
        summarise, "value binary, bound long")
    # summaries merge by adding counters; the k largest keep every value above the bound
    return per_task.groupBy("value").agg(F.sum("bound").alias("bound")) \
        .orderBy(F.desc("bound"), "value").limit(k)


def decide(rows: DataFrame, id_col: str, digest_col: str, k: int = HEAVY) -> DataFrame:
    """Add ``keep_id``, ``group_size`` and ``kept`` to rows with a binary digest."""
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return rows.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(0).cast("long"),
                                 "kept": F.lit(True)})
    # the candidates number at most k (the limit in ``frequent``): bound of the broadcast
    names = [r["value"] for r in frequent(rows, digest_col, k).collect()]
    candidates = few_rows(spark, [(bytes(v),) for v in names], "_digest binary")
    winners = rows.join(F.broadcast(candidates), F.col(digest_col) == F.col("_digest"), "left_semi") \
        .groupBy(F.col(digest_col).alias("_digest")) \
        .agg(F.count(F.lit(1)).alias("_size"), F.max(id_col).alias("_winner")) \
        .where(F.col("_size") * 2 * (k + 1) > F.lit(total))     # verified: really frequent
    heavy = few_rows(spark, winners.collect(), winners.schema)
    split = rows.join(F.broadcast(heavy), F.col(digest_col) == F.col("_digest"), "left").drop("_digest")
    loses = F.col("_size").isNotNull() & F.col("_winner").isNotNull() & \
        (F.col(id_col).isNull() | (F.col(id_col) != F.col("_winner")))
    cols = [F.col(f"`{c}`") for c in rows.columns]
    hot = split.where(loses).select(
        *cols, F.col("_winner").alias("keep_id"), F.col("_size").alias("group_size"), F.lit(False).alias("kept"))
    group = Window.partitionBy(digest_col)
    ordered = group.orderBy(F.desc_nulls_last(id_col))
    rest = split.where(~loses).select(
        *cols, F.max(id_col).over(group).alias("keep_id"),
        F.coalesce(F.col("_size"), F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"))
    return rest.unionByName(hot)


def text_digest(text_col: str = "text", normalise=None) -> F.Column:
    """SHA-256 (binary) of the text's UTF-8 bytes; ``normalise`` maps the column first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.unhex(F.sha2(normalise(text) if normalise else text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise=None, k: int = HEAVY) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    digests = stored(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col, normalise).alias("digest")),
                     "digests")
    return decide(digests, "doc_id", "digest", k).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """The rows that stay, with all their columns; only losers' ids are joined back.

    Rows are found again by (id, digest); a repeated row of a winner is dropped
    by its occurrence number, so exactly one stays.
    """
    sha, number, ident, digest, keep = (free_name(docs, n) for n in ("_sha", "_number", "_id", "_d", "_keep"))
    marked = docs.withColumn(sha, text_digest(text_col))
    digests = stored(marked.select(F.col(id_col).alias("id"), F.col(sha).alias("d")), "digests")
    kept = decide(digests, "id", "d", k).groupBy("id", "d").agg(
        F.max("kept").alias("keep"), F.count(F.lit(1)).alias("times"))
    gone = kept.where(~F.col("keep") | (F.col("times") > 1)).select(
        F.col("id").alias(ident), F.col("d").alias(digest), F.col("keep").alias(keep))
    if gone.count() * 64 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)            # checked size; beyond it the join shuffles
    whole = marked.join(gone, F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(sha) == F.col(digest)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = whole.where(F.col(keep).isNull()).select(*names)
    # winners that occur more than once are few: one row each stays
    repeated = whole.where(F.col(keep)).withColumn(
        number, F.row_number().over(Window.partitionBy(ident, digest).orderBy(F.lit(1))))
    return single.unionByName(repeated.where(F.col(number) == 1).select(*names))
