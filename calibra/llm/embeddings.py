"""Embedding near-dedup (operator 6): sorted projection passes.

Each pass draws its own random hyperplanes and orders the vectors lexicographically by
their concatenated sign bits (ties by a hash).  Every vector is compared with the
``window`` vectors after it in that order; pairs are verified by cosine in double
precision, and the verified pairs of all passes are united.

Exact copies are taken out first: one class per distinct vector with its number
of copies, so a vector that a third of all rows share costs one comparison and
its links are still counted in full.

Order and windows.  The (pass, bits, tie) order is cut by a range partitioning into
buckets of some windows each; a bucket is extended by the last ``window`` vectors of
the one before it, so windows reach over its border.  A row carries its vector and a few
numbers, whatever the number of passes.

What a pass is sure of.  Let a vector share ``b`` leading bits with the vectors at the two
edges of its window.  All vectors that share more of them lie inside, so a pair of it
at cosine ``c`` has been compared with probability ``(1 - acos(c)/pi) ** (b + 1)`` at
least.  A vector is *settled* when its passes together miss a pair with at most
``1 - recall``; with an evenly spread table ``passes_for`` many passes do.  Where data
is dense, the window's edges still share nearly all bits and vectors stay open.

Exact step.  A pair with a settled end has been found; pairs of two open vectors are
compared exactly, by the triangle inequality: open vectors are dealt to blocks around
pivots, and each visits the blocks that its radius reaches.  A block that lies wholly
within the radius and is itself narrow is all linked: it is counted without a comparison.  Only
counts and spanning edges leave this step, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows with
a null id take part and have a null component only if all ids of their component
are null; repeated ids count per row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.components import components
from calibra.llm.scratch import stored
from calibra.operators.pivots import _draw_pivots, _matrix, _placed, build

BITS = 62
WINDOW = 1024
#: windows per bucket of the order, and rows of a block of the exact step
WINDOWS, BLOCK = 4, 1024
RECALL = 0.9999


def agreement(cosine: float) -> float:
    """Probability that a random hyperplane leaves two vectors at this cosine on one side."""
    return 1 - math.acos(cosine) / math.pi


def passes_for(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes after which a vector of an evenly spread table is settled.

    ``log2(n / window)`` bits lead to the window; one more is asked for, and one for the
    unevenness of the order.
    """
    bits = math.log2(max(1, n) / window)
    if bits <= 0:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement(cosine) ** min(BITS, bits + 2))))


def _planes(dims: int, number: int) -> np.ndarray:
    return np.random.default_rng([dims, number]).standard_normal((dims, BITS))


def vector_classes(rows: DataFrame, vec_col: str) -> DataFrame:
    """``class_key, vec (array<double>), id, copies`` of the distinct usable vectors."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda x: x != 0)
    # + 0.0 makes the two zeros one
    return rows.select("row_id", F.transform(v, lambda x: x + F.lit(0.0)).alias("vec"),
                       (F.coalesce(finite & nonzero, F.lit(False))).alias("usable"))


def project(classes: DataFrame, passes: int) -> DataFrame:
    """``node, pass, dims, key``: the sign bits of every class in every pass, as one number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            nodes = b.column("node").to_numpy()
            for dims, which, x in _by_length(b.column("vec")):
                for p in range(passes):
                    key = ((x @ _planes(dims, p)) >= 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_pydict({
                        "node": nodes[which], "pass": np.full(len(which), p, dtype=np.int32),
                        "dims": np.full(len(which), dims, dtype=np.int32), "key": key})

    return classes.select("node", "vec").mapInArrow(work, "node long, pass int, dims int, key long")


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows, their vectors as a matrix) of a list column."""
    lengths = np.asarray(lists.value_lengths())
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
    for dims in np.unique(lengths):
        which = np.flatnonzero(lengths == dims)
        yield int(dims), which, flat[offsets[which][:, None] + np.arange(dims)]


def _units(classes: DataFrame) -> DataFrame:
    """``node, vec, copies, dims``: the vectors at length 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, which, x in _by_length(b.column("vec")):
                # scaled by the largest component first: lengths neither overflow nor vanish
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(at), pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * dims),
                                                                         pa.array(x.ravel())),
                     b.column("copies").take(at), pa.array(np.full(len(which), dims, dtype=np.int32))],
                    names=["node", "vec", "copies", "dims"])

    return classes.select("node", "vec", "copies").mapInArrow(work, "node long, vec array<double>, copies long, dims int")


def ordered(keys: DataFrame, passes: int, n: int, window: int) -> DataFrame:
    """``node, pass, dims, key, tie, bucket, halo``: the buckets of the order, each with the last
    ``window`` rows of the one before it (``halo``)."""
    parts = max(1, passes * n // (WINDOWS * window))
    order = ["pass", "dims", "key", "tie"]
    rows = stored(keys.withColumn("tie", F.xxhash64("node", "pass")).repartitionByRange(parts, *order)
                  .withColumn("bucket", F.spark_partition_id()), "order")
    last = Window.partitionBy("bucket").orderBy(*[F.col(c).desc() for c in order])
    halo = rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= window).drop("_n") \
        .withColumn("bucket", F.col("bucket") + 1)
    return rows.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)))


#: what a row of ``compare`` is: a pair (node, other), or the shared bits on one side of node's window
PAIR, LEFT, RIGHT = 0, 1, 2


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits two keys share."""
    x = (a ^ b).astype(np.uint64)
    # the exponent of a number of up to 62 bits, without rounding up to the next power
    high = np.frexp((x >> np.uint64(31)).astype(np.float64))[1]
    low = np.frexp((x & np.uint64((1 << 31) - 1)).astype(np.float64))[1]
    return BITS - np.where(x >> np.uint64(31) > 0, high + 31, low)


def compare(placed: DataFrame, ends: dict, cosine: float, window: int) -> DataFrame:
    """``node, other, kind, value`` of every bucket: linked pairs, and the bits shared at window edges (``value``).

    ``ends``: (pass, dims) -> its first and last bucket; there windows end with the order.
    """

    def one(table: pa.Table) -> pa.Table:
        p, dims, bucket = (table.column(c)[0].as_py() for c in ("pass", "dims", "bucket"))
        order = np.lexsort((table.column("tie").to_numpy(), table.column("key").to_numpy()))
        nodes, key, halo = (table.column(c).to_numpy()[order] for c in ("node", "key", "halo"))
        x = table.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dims)[order]
        m, first, last = len(nodes), *ends[p, dims]
        out: list[tuple] = []
        asked, sides = np.zeros(m), np.zeros(m, dtype=np.int64)
        for kind, near, far, at_end in ((LEFT, slice(window, m), slice(0, max(0, m - window)), bucket == first),
                                        (RIGHT, slice(0, max(0, m - window)), slice(window, m), bucket == last)):
            bits, known = np.zeros(m), np.full(m, at_end)
            if m > window:
                bits[near], known[near] = _shared_bits(key[near], key[far]) + 1, True
            asked, sides = np.maximum(asked, bits), sides + known
            if kind == LEFT:
                known &= ~halo       # the left window of a halo row lies in its own bucket
            which = np.flatnonzero(known)
            out.append((nodes[which], nodes[which], np.full(len(which), kind), bits[which]))
        # a pass is sure of a pair that shares what one end's window asks for; others need not be
        # told, so a crowd that ties in all bits sends none (where an edge is unknown all are told)
        asked[sides < 2] = 0
        for lo in range(0, m, 256):
            hi, back = min(lo + 256, m), max(0, lo - window)
            i, j = np.nonzero(x[lo:hi] @ x[back:hi].T >= cosine)
            i, j = i + lo, j + back
            keep = (j < i) & (i - j <= window) & ~(halo[i] & halo[j])
            i, j = i[keep], j[keep]
            keep = _shared_bits(key[i], key[j]) >= np.minimum(asked[i], asked[j])
            i, j = i[keep], j[keep]
            out.append((np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), np.full(len(i), PAIR), np.zeros(len(i))))
        node, other, kind, value = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"node": node.astype(np.int64), "other": other.astype(np.int64), "pass": np.full(len(node), p, np.int32),
                         "kind": kind.astype(np.int32), "value": value.astype(np.int32)})

    return placed.groupBy("bucket", "pass", "dims").applyInArrow(one, "node long, other long, pass int, kind int, value int")


def settled(found: DataFrame, cosine: float, recall: float) -> DataFrame:
    """``node`` of the vectors whose passes together miss a pair with at most ``1 - recall``."""
    sides = found.where(F.col("kind") != PAIR).groupBy("node", "pass").agg(
        F.max("value").alias("bits"), F.count_distinct("kind").alias("sides")).where("sides = 2")
    miss = 1 - F.pow(F.lit(agreement(cosine)), F.col("bits"))
    # beyond all bits (the edge's key equals the vector's) a pass is sure of nothing
    sure = F.when(F.col("bits") == 0, 1e6).when(F.col("bits") > BITS, 0.0).otherwise(-F.log(miss))
    return sides.groupBy("node").agg(F.sum(sure).alias("sure")).where(F.col("sure") >= -math.log(1 - recall)).select("node")


def exact_links(open_: DataFrame, dims: int, cosine: float) -> DataFrame:
    """``node, other, links`` among ``node, vec, copies`` rows of one length: every node's links as
    counts in several rows, and edges that connect what is linked."""
    spark = open_.sparkSession
    rows = stored(open_.select(F.col("node").alias("id"), F.col("vec").alias("x"), "copies"), "open")
    n = rows.count()
    points = _draw_pivots(rows, n, BLOCK)
    placed = stored(_placed(rows, points, ["copies"]), "open-placed")
    blocks = build(placed, points, BLOCK)
    radius = math.sqrt(2 - 2 * cosine)
    narrow = 2 * blocks.high + blocks.slack <= radius

    def home(batch: pa.RecordBatch) -> np.ndarray:
        return blocks.block_of(batch.column("cell").to_numpy(), batch.column("d").to_numpy(), batch.column("id").to_numpy())

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(home(b)), b.column("copies"), b.column("id")], names=["block", "copies", "id"])

    # one row per block: its copies and the member that stands for it
    held = {r["block"]: (r["copies"], r["least"]) for r in placed.mapInArrow(sizes, "block long, copies long, id long").groupBy(
        "block").agg(F.sum("copies").alias("copies"), F.min("id").alias("least")).collect()}
    total = np.array([held.get(b, (0, 0))[0] for b in range(len(blocks.cell))], dtype=np.int64)
    least = np.array([held.get(b, (0, 0))[1] for b in range(len(blocks.cell))], dtype=np.int64)
    kinds = "block long, kind int, id long, copies long, other long, links long, x array<double>"
    names = [c.split()[0] for c in kinds.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies, x, own = b.column("id").to_numpy(), b.column("copies").to_numpy(), _matrix(b.column("x")), home(b)
            for lo in range(0, len(ids), 1024):
                hi = min(lo + 1024, len(ids))
                row, block = blocks.reach(x[lo:hi], np.full(hi - lo, radius), np.full(hi - lo, -1), 1)
                row = row + lo
                far = np.sqrt(((x[row] - blocks.pivots[blocks.cell[block]]) ** 2).sum(1)) if len(row) else np.empty(0)
                whole = narrow[block] & (far + blocks.high[block] + blocks.slack <= radius)
                # linked with all of a block: counts now, and an edge to the member that stands for it
                done = (block[whole], np.full(whole.sum(), 2), ids[row[whole]], least[block[whole]],
                        total[block[whole]] - np.where(own[row[whole]] == block[whole], copies[row[whole]], 0))
                here = np.arange(lo, hi)
                # kind 0: a member of its block; 1: a visit to compare; 2: counted already
                at = np.concatenate([here, row[~whole], row[whole]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own[here], block[~whole], done[0]])),
                     pa.array(np.concatenate([np.zeros(hi - lo), np.ones((~whole).sum()), done[1]]).astype(np.int32)),
                     pa.array(ids[at]), pa.array(copies[at]),
                     pa.array(np.concatenate([ids[here], ids[row[~whole]], done[3]])),
                     pa.array(np.concatenate([np.zeros(hi - lo + (~whole).sum(), np.int64), done[4]])),
                     # what is counted already needs no vector any more
                     pa.concat_arrays([b.column("x").take(pa.array(np.concatenate([here, row[~whole]]))),
                                       pa.nulls(int(whole.sum()), b.column("x").type)])], names=names)

    dealt = stored(placed.mapInArrow(deal, kinds), "open-dealt")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1)))
            for lo, hi in zip(edges, np.append(edges[1:], len(place)), strict=True):
                part, (b, kind) = batch.slice(lo, hi - lo), place[lo]
                if b != current:
                    current, members, block = b, [], None
                if kind == 0:
                    members.append((part.column("id").to_numpy(), part.column("copies").to_numpy(), _matrix(part.column("x"))))
                    continue
                if block is None:
                    block = [np.concatenate(c) for c in zip(*members, strict=True)]
                ids, x = part.column("id").to_numpy(), _matrix(part.column("x"))
                for at in range(0, len(ids), 1024):
                    out = _block_links(ids[at:at + 1024], x[at:at + 1024], *block, cosine)
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "other", "links"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.where("kind < 2").repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(
        meet, "node long, other long, links long")
    return met.unionByName(dealt.where("kind = 2").select(F.col("id").alias("node"), "other", "links"))


def _block_links(ids, x, members, copies, y, cosine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted links of the rows ``ids`` with a block's members, and edges that connect the linked ones."""
    i, j = np.nonzero(x @ y.T >= cosine)
    keep = ids[i] != members[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return (np.empty(0, np.int64),) * 3
    counts = np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
    names, place = np.unique(np.concatenate([ids, members]), return_inverse=True)
    a, b = place[:len(ids)][i], place[len(ids):][j]
    partner = np.full(len(names), -1)
    partner[a] = b
    extra = partner[b] < 0
    partner[b[extra]] = a[extra]
    has = np.flatnonzero(partner >= 0)
    linked = np.zeros(len(names), dtype=np.int64)
    np.add.at(linked, place[:len(ids)], counts)
    out = {"node": [names[has]], "other": [names[partner[has]]], "links": [linked[has]]}
    _more_edges(a, b, partner, names, out)
    return tuple(np.concatenate(out[c]).astype(np.int64) for c in ("node", "other", "links"))


def _more_edges(i, j, partner, names, out) -> None:
    """Edges that keep the block's linked vectors connected as the pairs (i, j) connect them.

    Labels start from the partner edges and pairs whose ends still differ are
    united one by one: at most one edge more per vector.
    """
    root = np.arange(len(partner))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a in np.flatnonzero(partner >= 0).tolist():
        x, y = find(a), find(int(partner[a]))
        root[max(x, y)] = min(x, y)
    while True:
        # flatten, then look for pairs that join two trees
        flat = root.copy()
        while not np.array_equal(flat, flat[flat]):
            flat = flat[flat]
        root[:] = flat
        apart = np.flatnonzero(flat[i] != flat[j])
        if not len(apart):
            return
        _, once = np.unique(flat[i[apart]] * len(root) + flat[j[apart]], return_index=True)
        for k in apart[once].tolist():
            x, y = find(int(i[k])), find(int(j[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out["node"].append(np.array([names[i[k]]]))
                out["other"].append(np.array([names[j[k]]]))
                out["links"].append(np.array([0]))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95,
                 window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    source = rows.select(F.col(id_col).alias("row_id"), F.col(vec_col))
    all_rows = stored(vector_classes(source, vec_col).withColumn(
        "key", F.when(F.col("usable"), F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256))),
        "vectors")
    classes = stored(all_rows.where("usable").groupBy("key").agg(
        F.first("vec").alias("vec"), F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    passes = passes_for(n, window, cosine, recall)
    units = stored(_units(classes), "units")
    order = ordered(stored(project(classes, passes), "keys"), passes, n, window)
    # at most one row per pass and length
    ends = {(r["pass"], r["dims"]): (r["a"], r["b"]) for r in order.where(~F.col("halo")).groupBy("pass", "dims").agg(
        F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()}
    # a halo row whose pass ends before its bucket has nothing to compare with there
    span = F.create_map(*[F.lit(x) for (p, d), (_, last) in ends.items() for x in (f"{p}|{d}", last)]) if ends else None
    inside = F.col("bucket") <= F.element_at(span, F.concat_ws("|", "pass", "dims")) if ends else F.lit(True)
    windows = stored(compare(order.where(inside).join(units.select("node", "vec"), "node"), ends, cosine, window), "windows")
    sure = stored(settled(windows, cosine, recall), "settled")
    open_ = stored(units.join(sure, "node", "left_anti"), "open-units")
    # pairs with a settled end come from the windows, each once; both ends count it
    pairs = windows.where(F.col("kind") == PAIR).select("node", "other").distinct()
    flagged = pairs.join(sure.select("node", F.lit(1).alias("s")), "node", "left") \
        .join(sure.select(F.col("node").alias("other"), F.lit(1).alias("t")), "other", "left") \
        .where("s IS NOT NULL OR t IS NOT NULL").select("node", "other")
    copies = units.select(F.col("node").alias("other"), F.col("copies").alias("links"))
    both = flagged.unionByName(flagged.select(F.col("other").alias("node"), F.col("node").alias("other")))
    found = both.join(copies, "other").select("node", "other", "links")
    for dims in [r[0] for r in open_.groupBy("dims").count().collect()]:
        found = found.unionByName(exact_links(open_.where(F.col("dims") == dims), dims, cosine))
    found = stored(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "other")
    known = classes.select("key", "node", "id", "copies").join(counts, "node", "left") \
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("id").alias("component_id"))
    labelled = known.join(smallest, "root").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return all_rows.select("row_id", "key").join(labelled, "key", "left").select(
        F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "row_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
