"""MinHash near-dedup (operator 8): one-permutation hashing, banded buckets, stars.

1. Each document's word shingles become a set of 64-bit hashes (sorted array).
   Documents with equal sets form one class; only its smallest id goes on.
2. One-permutation hashing: the hash range is cut into ``bands * rows`` equal
   bins; a bin's value is its smallest member, which in a sorted set is one
   binary search.  Empty bins borrow by optimal densification: bin ``i`` tries
   the bins ``H(i, 1), H(i, 2), ...`` (the same for all documents) and takes the
   first that is not empty.
3. ``rows`` successive bins form a band; equal bands share a bucket.  In a bucket
   every member is paired only with one hub (a star: size - 1 pairs instead of
   size squared).  The hub is the most central member: the one whose buckets hold
   the most members in all.  The original of a group of copies, which is nearer
   to each copy than the copies are to each other, is such a member, and it is
   the same one in most buckets, so few distinct pairs arise.
4. Pairs whose set sizes allow the threshold are confirmed on the full sets.
5. Buckets whose members do not yet form one component get further stars, between
   different components only: around every member of a bucket of at most ``HUBS``
   (which settles it), else around ``HUBS`` members drawn by a hash per bucket.
6. The members of larger buckets that still hold several components are compared
   exactly: two sets that reach the threshold share a shingle among the rarest
   ``size - ceil(threshold * size) + 1`` of each (prefix filter), so pairs of
   different components that share such a shingle, and that sizes and places in
   the order do not rule out, are confirmed.  No bucket size or partner count is
   capped: every link within a bucket is found, or its ends are joined already.

Two documents with similarity ``s`` share no bucket with probability
``(1 - s**rows)**bands``: 4e-5 at 0.85 with 32 bands of 8 rows, 1e-4 at 0.8 with
50 bands of 8 rows.

Defined results: a null text or one without words has an empty set and links
with nothing; fewer words than the shingle length make the whole sequence one
shingle.  Rows with a null id link with nothing and are their own component
(null).  Of a repeated id every row is judged by its own text.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.components import components
from calibra.llm.scratch import free_name, stored
from calibra.llm.text import U, chunks, gram_hashes, map_batches, mix, utf8, word_hashes

#: up to here the ids of documents with shared buckets are broadcast
BROADCAST_BYTES = 32 << 20
#: stars per bucket in the second round
HUBS = 8
#: counters (by the shingle's hash) that say which shingles are rare
SLOTS = 1 << 20
#: holders of one rare shingle that one task compares with the others
CELL = 1024


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the column."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        words, first = word_hashes(data, offsets[lo:hi + 1])
        grams = gram_hashes(words, n)
        for i in range(hi - lo):
            count = int(first[i + 1] - first[i])
            if count >= n:
                yield np.unique(grams[first[i]:first[i + 1] - n + 1])
            elif count:
                yield gram_hashes(words[first[i]:first[i + 1]], count)
            else:
                yield np.empty(0, dtype=U)


@lru_cache(maxsize=8)
def probes(bins: int) -> np.ndarray:
    """Row i: the bins that bin i tries when it is empty; every row reaches all bins."""
    tries = 8 * bins
    keys = np.arange(bins * tries, dtype=U).reshape(bins, tries) + U(1 << 40)
    drawn = (mix(keys) % U(bins)).astype(np.int64)
    return np.concatenate([drawn, np.broadcast_to(np.arange(bins), (bins, bins))], axis=1)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin of a sorted, non-empty set of hashes."""
    starts = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(U)
    at = np.searchsorted(hashes, starts)
    ends = np.append(at[1:], len(hashes))
    filled = ends > at
    out = hashes[np.minimum(at, len(hashes) - 1)]
    empty, table, lo, width = np.flatnonzero(~filled), probes(bins), 0, 8
    while len(empty):
        # the first filled bin of each one's probes; most have one among the first few
        tried = table[empty, lo:lo + width]
        hits = filled[tried]
        found = hits.any(axis=1)
        out[empty[found]] = out[tried[found, hits[found].argmax(axis=1)]]
        empty, lo, width = empty[~found], lo + width, 2 * width
    return out


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band (the band's number is part of it)."""
    block = sig.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=U)
    for r in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + block[:, r])
    return keys


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that name a set; null for the empty one."""
    if not len(s):
        return None
    return s.sum(dtype=U).tobytes() + mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).tobytes()


def profiles(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``id, n_shingles, set_key`` (128 bits, null for empty sets) and ``bands`` per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key, buckets = [], [], []
            for s in shingle_sets(b.column("text"), n):
                size.append(len(s))
                key.append(set_key(s))
                sig = signature(s, bands * rows) if len(s) else np.empty(0, dtype=U)
                buckets.append(bands_of(sig, bands, rows).astype(np.int64) if len(s) else np.empty(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32)
            values = np.concatenate(buckets) if buckets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["id", "n_shingles", "set_key", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, work, f"id {kind}, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``set_key, members`` (hashes as signed numbers) of the documents named in ``ids``."""
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)              # checked size; beyond it the join shuffles

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a set takes several times its text: few at a time
            for lo in range(0, b.num_rows, 500):
                sets = list(shingle_sets(b.slice(lo, 500).column("text"), n))
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["set_key", "members"])

    texts = docs.join(ids, "id", "left_semi").select("text")
    return map_batches(texts, work, "set_key binary, members array<long>") \
        .groupBy("set_key").agg(F.first("members").alias("members"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets reach the similarity:
    100 * common >= percent * union.  The sets stay in the JVM, a pair at a time."""
    first = sets.select(F.col("set_key").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("set_key").alias("b"), F.col("members").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    sizes = (F.size("x") + F.size("y")).cast("long")
    # union = sizes - common
    return pairs.join(first, "a").join(second, "b").where((100 + percent) * common >= percent * sizes).select("a", "b")


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """One star per bucket of ``bucket, set_key, size, weight`` rows: every member with the
    bucket's most central one (largest weight, ties by key)."""
    hubs = members.groupBy("bucket").agg(F.min(F.struct(
        (-F.col("weight")).alias("w"), F.col("set_key"), F.col("size"))).alias("hub"))
    return _fit(members.join(hubs, "bucket").where("set_key <> hub.set_key"), percent)


def later_pairs(members: DataFrame, percent: int, hubs: int) -> DataFrame:
    """Stars around all members of buckets of at most ``hubs`` (``n`` is the bucket's size), around up
    to ``hubs`` drawn by a hash of others: each with the members of other components (``root``)."""
    draw = F.xxhash64("set_key", "bucket")
    slot = F.when(F.col("n") <= hubs, F.col("set_key")).otherwise(F.pmod(draw, F.lit(hubs)).cast("string").cast("binary"))
    centres = members.groupBy("bucket", slot.alias("slot")).agg(
        F.min(F.struct(draw.alias("h"), F.col("set_key"), F.col("size"), F.col("root"))).alias("hub"))
    return _fit(members.join(centres, "bucket").where("root <> hub.root"), percent)


def _fit(paired: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes alone do not rule the similarity out."""
    small, large = F.least("size", "hub.size"), F.greatest("size", "hub.size")
    return paired.where(small * 100 >= large * percent).select(
        F.least("set_key", "hub.set_key").alias("a"), F.greatest("set_key", "hub.set_key").alias("b")).distinct()


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many members of the sets fall on each of ``SLOTS`` counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            n += np.bincount(_slots(b.column("members").flatten().to_numpy()), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": at.astype(np.int64), "n": n[at]})

    found = map_batches(sets.select("members"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = found.toArrow()                 # at most SLOTS rows
    out = np.zeros(SLOTS, dtype=np.int64)
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def _slots(members: np.ndarray) -> np.ndarray:
    return (members.view(U) & U(SLOTS - 1)).astype(np.int64)


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``set_key, root, size, place, shingle``: the rarest shingles of each set, as many as a set of
    that similarity cannot avoid.  The order (by counter, then hash) is the same for all sets."""
    shared = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))       # SLOTS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            sizes = np.asarray(b.column("members").value_lengths()).astype(np.int64)
            kept = sizes + (-sizes * percent) // 100 + 1
            values = b.column("members").flatten().to_numpy()
            rare = []
            for members, k in zip(np.split(values, np.cumsum(sizes)[:-1]), kept.tolist(), strict=True):
                rare.append(members[np.lexsort((members, often[_slots(members)]))[:k]])
            row = pa.array(np.repeat(np.arange(len(sizes)), kept))
            place = np.concatenate([np.arange(k) for k in kept]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("set_key").take(row), b.column("root").take(row), pa.array(sizes).take(row),
                 pa.array(place), pa.array(np.concatenate(rare))], names=["set_key", "root", "size", "place", "shingle"])

    return map_batches(sets.select("set_key", "root", "members"), work,
                       "set_key binary, root binary, size long, place long, shingle long")


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of ``set_key, root, members`` rows of different components that may reach the similarity.

    A shingle's holders are compared with those outside its largest component, so holders that
    are joined already cost nothing; holders of a frequent shingle are cut into cells.
    """
    rare = stored(rare_shingles(sets, percent), "rare")
    holders = rare.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")) \
        .where("roots > 1").select("shingle", F.col("top.root").alias("top"),
                                   F.ceil(F.col("n") / F.lit(CELL)).cast("int").alias("cells"))
    held = stored(rare.join(holders, "shingle"), "holders")
    left = held.withColumn("cell", F.pmod(F.xxhash64("set_key"), F.col("cells")).cast("int")).alias("x")
    right = held.where("root <> top").drop("top") \
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("y")
    # the first common shingle in the order leaves this many that can be common
    most = F.least(F.expr("x.size - x.place"), F.expr("y.size - y.place"))
    both = left.join(right, ["shingle", "cell"]).where("x.root <> y.root AND (x.root = x.top OR x.set_key < y.set_key)")
    return both.where((100 + percent) * most >= percent * F.expr("x.size + y.size")).select(
        F.least("x.set_key", "y.set_key").alias("a"), F.greatest("x.set_key", "y.set_key").alias("b")).distinct()


def class_roots(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``set_key, root`` of the members' classes: two rounds of stars, then what these leave open."""
    alone = members.select("set_key", F.col("set_key").alias("root")).distinct()
    found = stored(confirm(first_pairs(members, percent), sets, percent), "links")
    roots = stored(_merge(alone, found), "roots")
    labelled = members.join(roots, "set_key")
    found = stored(confirm(later_pairs(labelled.join(_several(labelled), "bucket"), percent, HUBS), sets, percent), "links")
    roots = stored(_merge(roots, found), "roots")
    labelled = members.join(roots, "set_key")
    # smaller buckets have been compared in full
    left = _several(labelled).where(F.col("n") > HUBS)
    left = stored(labelled.join(left, "bucket").select("set_key", "root").distinct(), "left")
    if left.isEmpty():
        return roots
    found = stored(confirm(rare_pairs(left.join(sets, "set_key"), percent), sets, percent), "links")
    return _merge(roots, found)


def _several(labelled: DataFrame) -> DataFrame:
    """``bucket, n`` (members) of the buckets that hold several components."""
    return labelled.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .where("lo <> hi").select("bucket", "n")


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Unite the components that new links join; only their roots are contracted again."""
    of_a = roots.select(F.col("set_key").alias("a"), F.col("root").alias("ra"))
    of_b = roots.select(F.col("set_key").alias("b"), F.col("root").alias("rb"))
    joined = components(links.join(of_a, "a").join(of_b, "b"), "ra", "rb")
    return roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left") \
        .select("set_key", F.coalesce("new", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, bands: int = 50, rows: int = 8) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = stored(profiles(source, shingle, bands, rows), "profiles")
    # classes of equal sets; the pre-aggregated minimum stands for thousands of copies
    classes = stored(all_rows.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("set_key", "size", "id", F.explode("bands").alias("bucket"))
    # buckets with one member propose nothing
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(buckets.join(shared, "bucket"), "buckets")
    weights = crowded.groupBy("set_key").agg(F.sum("n").alias("weight"))
    members = stored(crowded.drop("n").join(weights, "set_key"), "members")
    sets = stored(sets_of(source, members.select("id").distinct(), shingle), "sets")
    roots = class_roots(members.drop("id"), sets, percent)
    rooted = classes.select("set_key", "id").join(roots, "set_key").select("set_key", "id", "root")
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = rooted.join(smallest, "root").select("set_key", "component_id")
    final = classes.select("set_key", "id").join(linked, "set_key", "left") \
        .select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    return all_rows.join(final, "set_key", "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that stay: one of each group, with all their columns.

    A document is its id and its text: of rows with one id and different texts each is judged by
    its own text.  Rows that equal another in both stay together.
    """
    name, digest = free_name(docs, "gone"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    # the smallest id stays, and of one id's texts that with the smallest digest
    pairs = docs.select(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), digest.alias("text"))).alias("pair"),
                        F.col(text_col).alias("text"))
    gone = near_duplicates(pairs, "pair", "text", **kw).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    if gone.count() * 100 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)            # checked size; beyond it the join shuffles
    same = (F.col(id_col) == F.col(f"{name}.id")) & (digest == F.col(f"{name}.text"))
    return docs.join(gone, same, "left_anti")
