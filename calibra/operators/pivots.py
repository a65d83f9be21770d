"""Exact k-nearest-neighbour join by pivots.

1. A bounded number of reference rows, drawn by a hash of their ids, become pivots.
   Every reference row belongs to the cell of its nearest pivot, and inside the cell
   to a ring of distances to the pivot; a ring with too many rows is split by a hash
   of the ids.  The result is blocks of bounded size, each with its pivot and the
   least and greatest distance to it.
2. Every query row first meets the one block in whose ring it lies.  The k-th distance
   found there is its radius.
3. It is then sent only to those other blocks that the triangle inequality lets the
   radius reach: ring [lo, hi] of pivot p is out of reach when d(q, p) - hi or
   lo - d(q, p) exceeds the radius, a whole cell when q lies farther than that
   beyond the plane between the cell's pivot and q's own.
4. The k best of a query row's candidates are its neighbours (ties by id).

Both sides stay distributed: the driver holds pivots and block bounds, which are
bounded by parameters, and a task one block at a time while query rows stream by.
A block that very many query rows reach is copied, and the rows are dealt to the
copies.  Of equal reference vectors only the k + 1 least ids can be neighbours; the
others are left out by a partial group limit before anything else is shuffled.

The same steps serve every size.  Work is the number of (query row, block row) pairs
in reach: small where data are clustered, up to all pairs where a radius reaches
everything, as in high-dimensional noise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.session import cut_lineage

#: rows of a block (a ring of a cell) and cells at most; rings of a cell at most
BLOCK_ROWS, MAX_PIVOTS, MAX_RINGS = 4096, 1024, 64
#: query rows that one copy of a block answers
COPY_ROWS = 200_000
#: relative slack of the bounds: distances to pivots come from a matrix product
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _mix(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances from rows of ``a`` to rows of ``b``, up to rounding of a matrix product."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def nearest(q: np.ndarray, qids: np.ndarray, r: np.ndarray, rids: np.ndarray, radius: np.ndarray, k: int,
            exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, distance) of the k nearest within each row's radius, by (distance, id).

    A matrix product gives all squared distances up to a rounding error of at most ``off``; only pairs that
    may be among the k nearest within it are then measured by their differences.
    """
    out: list[tuple] = []
    with np.errstate(over="ignore"):
        r2 = (r * r).sum(1)
    step = max(1, 4_000_000 // max(1, len(r)))
    unit = 4.0 * (r.shape[1] + 8) * np.finfo(np.float64).eps
    for s in range(0, len(q), step):
        own, ids, reach = q[s:s + step], qids[s:s + step], radius[s:s + step]
        with np.errstate(invalid="ignore", over="ignore"):
            q2 = (own * own).sum(1)
            square = q2[:, None] + r2[None, :] - 2.0 * (own @ r.T)
            most = q2 + np.max(r2, where=np.isfinite(r2), initial=0.0)
            off = unit * most
            if not np.isfinite(most[np.isfinite(own).all(1)]).all() or not np.isfinite(r2[np.isfinite(r).all(1)]).all():
                # finite vectors whose squares aren't: every pair is measured
                square, off = np.zeros_like(square), np.full(len(own), np.inf)
            if exclude_self:
                square[ids[:, None] == rids[None, :]] = np.inf
            kth = np.partition(square, min(k, len(rids)) - 1, axis=1)[:, min(k, len(rids)) - 1]
            limit = np.minimum(kth, reach * reach * (1 + unit)) + 2 * off
            row, col = np.nonzero((square <= limit[:, None]) & (square < np.inf))
        d = np.empty(len(row))
        part = max(1, 2_000_000 // max(1, r.shape[1]))
        for lo in range(0, len(row), part):
            diff = own[row[lo:lo + part]] - r[col[lo:lo + part]]
            d[lo:lo + part] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        near = np.flatnonzero((d <= reach[row]) & np.isfinite(d))
        row, col, d = row[near], col[near], d[near]
        order = np.lexsort((rids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((row[rank < k] + s, col[rank < k], d[rank < k]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Blocks:
    """Pivots, and per block its cell, ring bounds and number of rows."""

    pivots: np.ndarray                 # cells x dims
    cuts: list                         # per cell: ascending ring bounds
    slack: float
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    home: list                         # per cell and ring: (first block, number of blocks)
    between: np.ndarray                # distances between pivots

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of every row."""
        d = distances(x, self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell]

    def block_of(self, cell: np.ndarray, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The block of every row: ring of its cell, split by a hash of the id."""
        out = np.empty(len(cell), dtype=np.int64)
        h = _mix(ids)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            home = np.array(self.home[c], dtype=np.int64)
            first, parts = home[np.searchsorted(self.cuts[c], d[at])].T
            out[at] = first + (h[at] % parts.astype(np.uint64)).astype(np.int64)
        return out

    def reach(self, x: np.ndarray, radius: np.ndarray, home: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks but the row's home that its radius may reach.

        An infinite radius (fewer than k rows at home) is replaced by the distance within
        which the nearest cells as a whole hold k + 1 rows.
        """
        rows, blocks = [], []
        order = np.argsort(self.cell, kind="stable")
        starts = np.searchsorted(self.cell[order], np.arange(len(self.pivots) + 1))
        least = np.array([self.low[self.cell == c].min(initial=np.inf) for c in range(len(self.pivots))])
        most = np.array([self.high[self.cell == c].max(initial=-np.inf) for c in range(len(self.pivots))])
        held = np.bincount(self.cell, weights=self.rows, minlength=len(self.pivots))
        step = max(1, 4_000_000 // max(1, len(self.pivots)))
        for s in range(0, len(x), step):
            d = distances(x[s:s + step], self.pivots)
            own = d.argmin(1)
            near = radius[s:s + step, None] * (1 + SLACK) + self.slack
            for i in np.flatnonzero(np.isinf(near[:, 0])):
                far = d[i] + most
                by = np.argsort(far)
                enough = np.searchsorted(np.cumsum(held[by]), k + 1)
                if enough < len(by):
                    near[i] = far[by[enough]] * (1 + SLACK) + self.slack
            apart = self.between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - np.take_along_axis(d, own[:, None], 1) ** 2) / (2 * apart)
            plane = np.where(apart > 0, plane, 0.0)
            # the plane's bound loses precision where pivots lie close together
            plane -= self.slack * (1 + np.where(apart > 0, (d + d.min(1)[:, None]) / np.maximum(apart, 1e-300), 0.0))
            row, c = np.nonzero(np.maximum(np.maximum(d - most, least - d), plane) <= near)
            sizes = starts[c + 1] - starts[c]
            row_of = np.repeat(np.arange(len(row)), sizes)
            block = order[np.repeat(starts[c], sizes) + np.arange(len(row_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            dist = d[row[row_of], c[row_of]]
            ok = np.maximum(dist - self.high[block], self.low[block] - dist) <= near[row[row_of], 0]
            r, b = row[row_of][ok] + s, block[ok]
            away = b != home[r]
            rows.append(r[away])
            blocks.append(b[away])
        return (np.concatenate(rows), np.concatenate(blocks)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _draw_pivots(ref: DataFrame, n: int, block_rows: int) -> np.ndarray:
    """Distinct vectors of the reference rows whose ids hash lowest."""
    wanted = min(MAX_PIVOTS, max(1, -(-n // block_rows)))
    rows = ref.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(wanted).select("x").collect()
    return np.unique(np.array([r[0] for r in rows], dtype=np.float64), axis=0)


def _placed(ref: DataFrame, pivots: np.ndarray, carry: Sequence[str]) -> DataFrame:
    """Reference rows with ``cell`` and ``d``, their distance to its pivot."""
    blank = Blocks(pivots, [], 0.0, *[np.empty(0)] * 4, [], np.empty(0))
    schema = ref.select("id", "x", *carry, F.lit(0).alias("cell"), F.lit(0.0).alias("d")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = blank.place(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d)],
                                             names=[*b.schema.names, "cell", "d"])

    return ref.mapInArrow(work, schema)


def build(placed: DataFrame, pivots: np.ndarray, block_rows: int) -> Blocks:
    """Rings and blocks from two small aggregations: quantiles per cell, counts per ring."""
    probs = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    cuts: list = [np.empty(0)] * len(pivots)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", probs, 1000).alias("q")).collect():
        rings = min(MAX_RINGS, -(-r["n"] // block_rows))
        every = [r["q"][round(i * MAX_RINGS / rings) - 1] for i in range(1, rings)]
        cuts[r["cell"]] = np.unique(np.array(every, dtype=np.float64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = (b.column(i).to_numpy() for i in (0, 1))
            rings = np.empty(len(cell), dtype=np.int32)
            for c in np.unique(cell):
                rings[cell == c] = np.searchsorted(cuts[c], d[cell == c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rings), b.column(1)], names=["cell", "ring", "d"])

    found = placed.select("cell", "d").mapInArrow(count, "cell int, ring int, d double").groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
    found.sort(key=lambda r: (r["cell"], r["ring"]))
    blocks, home = [], [[None] * (len(c) + 1) for c in cuts]
    for r in found:
        parts = max(1, -(-r["n"] // (2 * block_rows)))
        home[r["cell"]][r["ring"]] = (len(blocks), parts)
        blocks += [(r["cell"], r["low"], r["high"], r["n"] / parts)] * parts
    for rings in home:
        # query rows of an empty ring begin in the nearest one that isn't
        there = [i for i, h in enumerate(rings) if h]
        for i, h in enumerate(rings):
            if not h:
                rings[i] = rings[min(there, key=lambda t: abs(t - i))] if there else (0, 1)
    cell, low, high, rows = (np.array(c) for c in zip(*blocks, strict=True))
    between = distances(pivots, pivots)
    scale = float(np.abs(pivots).max(initial=0.0)) * np.sqrt(pivots.shape[1]) + float(high.max(initial=0.0))
    return Blocks(pivots, cuts, SLACK * scale, cell, low, high, rows, home, between)


def _copies(counts: dict, n_blocks: int) -> np.ndarray:
    copies = np.ones(n_blocks, dtype=np.int64)
    for block, n in counts.items():
        copies[block] = max(1, -(-n // COPY_ROWS))
    return copies


VISIT = "block int, copy int, kind int, id long, x array<double>, radius double"


def _search(spark, ref_rows: DataFrame, visits: DataFrame, k: int, exclude_self: bool, carry: Sequence[str], kinds) -> DataFrame:
    """``q_id, nn_id, distance, carry`` and the radius-defining k best of every visit."""
    both = ref_rows.unionByName(visits, allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind")
    columns = ["block", "copy", "kind", "id", "x", "radius", *carry]
    schema = "q_id long, nn_id long, distance double" + "".join(f", {c} {t}" for c, t in kinds)
    names = ["q_id", "nn_id", "distance", *carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1)))
            for lo, hi in zip(edges, np.append(edges[1:], len(place)), strict=True):
                part, (b, c, kind) = batch.slice(lo, hi - lo), place[lo]
                if (b, c) != current:
                    current, held, block = (b, c), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    block = (_matrix(table.column("x").combine_chunks()), table.column("id").to_numpy(), table)
                qids = part.column(3).to_numpy()
                row, col, d = nearest(_matrix(part.column(4)), qids, block[0], block[1], part.column(5).to_numpy(), k,
                                      exclude_self)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qids[row]), pa.array(block[1][col]), pa.array(d),
                         *[block[2].column(x).take(pa.array(col)).combine_chunks() for x in carry]], names=names)

    return ordered.select(*columns).mapInArrow(work, schema)


def knn_join(query: DataFrame, ref: DataFrame, k: int, id_col: str, features: str, exclude_self: bool,
             carry: Sequence[str], block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """``q_id, nn_id, distance, rank, <carry>``; ``report`` receives the numbers of blocks and of
    (query row, reference row) pairs that were compared."""
    spark = query.sparkSession
    kinds = [(c, ref.schema[c].dataType.simpleString()) for c in carry]
    schema = "q_id long, nn_id long, distance double, rank int" + "".join(f", {c} {t}" for c, t in kinds)
    empty = spark.createDataFrame([], schema)

    def vectors(df: DataFrame, extra: Sequence[str]) -> DataFrame:
        return df.where(F.col(features).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"), *extra)

    q, r = vectors(query, ()), vectors(ref, carry)
    if k <= 0:
        return empty
    # equal vectors: only the k + 1 least ids can be anybody's neighbours
    same = Window.partitionBy("x").orderBy("id")
    r = r.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    r = cut_lineage(r)
    n = r.count()
    if not n:
        return empty
    pivots = _draw_pivots(r, n, block_rows)
    placed = cut_lineage(_placed(r, pivots, carry))
    blocks = build(placed, pivots, block_rows)
    parts = len(blocks.cell)

    def in_block(copies: np.ndarray) -> DataFrame:
        """Reference rows with their block, once per copy of it."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy()
                block = blocks.block_of(b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy(), ids)
                times = copies[block]
                at = pa.array(np.repeat(np.arange(len(ids)), times))
                copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(block, times).astype(np.int32)), pa.array(copy.astype(np.int32)),
                     pa.array(np.zeros(len(at), dtype=np.int32)), b.column(0).take(at), b.column(1).take(at),
                     pa.nulls(len(at), pa.float64()), *[b.column(2 + i).take(at) for i in range(len(carry))]],
                    names=["block", "copy", "kind", "id", "x", "radius", *carry])

        return placed.mapInArrow(work, VISIT + "".join(f", {c} {t}" for c, t in kinds))

    def visits(side: DataFrame, copies: np.ndarray | None) -> DataFrame:
        """Visits of query rows (id, x, radius): home blocks where the radius is null, else all others in
        reach.  Without ``copies`` only the number of visits per block."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x, radius = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                home = blocks.block_of(*blocks.place(x), ids)
                if b.column(2).null_count:
                    row, block, radius = np.arange(len(ids)), home, np.full(len(ids), np.inf)
                else:
                    row, block = blocks.reach(x, radius, home, k)
                if copies is None:
                    n = np.bincount(block, minlength=parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])],
                                                     names=["block", "n"])
                    continue
                at = pa.array(row)
                copy = (_mix(ids[row]) % copies[block].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int32)), pa.array(copy), pa.array(np.ones(len(row), dtype=np.int32)),
                     b.column(0).take(at), b.column(1).take(at), pa.array(radius[row])],
                    names=["block", "copy", "kind", "id", "x", "radius"])

        return side.mapInArrow(work, "block int, n long" if copies is None else VISIT)

    def meet(side: DataFrame) -> DataFrame:
        counts = {x["block"]: x["n"] for x in visits(side, None).groupBy("block").agg(F.sum("n").alias("n")).collect()}
        if report is not None:
            report["blocks"] = parts
            report["pairs"] = report.get("pairs", 0) + int(sum(blocks.rows[b] * c for b, c in counts.items()))
        copies = _copies(counts, parts)
        return _search(spark, in_block(copies), visits(side, copies), k, exclude_self, carry, kinds)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q_id").orderBy("distance", "nn_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = meet(q.withColumn("radius", F.lit(None).cast("double")))
    if parts > 1:
        first = cut_lineage(first)
        # the k-th distance at home; without one nothing bounds the search
        radius = first.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).select(
            F.col("q_id").alias("id"), F.when(F.col("n") >= k, F.col("far")).alias("radius"))
        known = q.join(radius, "id", "left").select("id", "x", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        first = first.unionByName(meet(cut_lineage(known)))
    return best(first).select("q_id", "nn_id", "distance", F.col("rank").cast("int").alias("rank"), *carry)
