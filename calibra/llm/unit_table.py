"""Token ids of a corpus' frequent units, worked out once and memory-mapped by workers.

A *unit* is a run of bytes that a tokenizer encodes independently of its neighbours
(a word, or a word with the space before it).  Every task cuts its texts into
units without an object per unit, counts the distinct ones and sends packed blocks, one
per part of a shard of the hash range.  One task per shard merges them part by part (so it
holds ``1 / PARTS`` of them at once), lets the tokenizer encode each unit that occurs
``LEAST`` times or more, and writes sorted 64-bit hashes with the ids to the shared folder of ``spark.checkpoint.dir``.  Workers then turn texts
into ids by looking hashes up; rarer and longer units are encoded where they stand.

The table holds at most (units of the corpus / LEAST) entries.  Two units of one
hash are noticed while merging (a second hash tells them apart), and the table is
built anew with other hashes.  Files are renamed into place, so a task that runs
twice leaves one file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.ngram_lm import _map, _save, local_folder, shard_of
from calibra.llm.text import IS_SPACE, U, chunks, map_batches, mix, utf8

#: how often a unit must occur to enter the table, and the longest that does, in bytes
LEAST, LONGEST = 2, 64
#: distinct units that a counting task holds before it hands them on
HELD = 400_000
#: equal parts of a shard's hash range, which its task merges one after another
PARTS = 16

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_runs(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """(starts, ends, first run of each text) of the runs of bytes other than space and 0x09-0x0D."""
    inside = ~IS_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    at = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[at] = inside[at]
    ends[at - 1] = inside[at - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def spaced_runs(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs that begin with a text or with a space after a character which is no white space.

    No match of a pattern that takes white space only at its beginning or as a whole reaches
    over such a place.
    """
    begins = np.zeros(len(raw) + 1, dtype=bool)
    at = np.flatnonzero(raw == 0x20)
    at = at[at >= 1]
    one, two, three = (raw[np.maximum(at - i, 0)] for i in (1, 2, 3))
    blank = IS_SPACE[one] | ((one >= 0x1C) & (one <= 0x1F))
    # white space beyond ASCII ends with these bytes; some of what is left out here is none
    blank |= ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A))
    blank |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    begins[at[~blank]] = True
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins[:-1])
    return starts, np.append(starts[1:], len(raw))[:len(starts)], np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all pieces, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def run_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of every run; none is empty or longer than ``LONGEST``."""
    if not len(starts):
        return np.empty(0, dtype=U)
    keys = mix((np.arange(LONGEST, dtype=U) + U(1 + salt * LONGEST)) * U(0x9E3779B97F4A7C15)) | U(1)
    at = spread(starts, lengths)
    begin = np.cumsum(lengths) - lengths
    values = (raw[at].astype(U) + U(1)) * keys[np.arange(len(at)) - np.repeat(begin, lengths)]
    return mix(np.add.reduceat(values, begin) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class UnitTable:
    """What a worker needs to look units up."""

    folder: str
    shards: int
    salt: int
    cutter: Callable[[np.ndarray, np.ndarray], Runs]


class _Counted:
    """Distinct units of a task: hashes, counts, lengths and their bytes."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, keys, counts, lengths, data) -> None:
        self.parts.append((keys, counts, lengths, data))
        self.size += len(keys)

    def merge(self) -> tuple:
        """All parts as one, in hash order."""
        keys, counts, lengths, data = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (
            np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        begin = np.cumsum(lengths) - lengths
        merged = (unique, np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64), lengths[first],
                  data[spread(begin[first], lengths[first])])
        self.parts, self.size = [merged], len(unique)
        return merged


BLOCK = "shard int, part int, keys binary, counts binary, lengths binary, data binary"


def count_units(docs: DataFrame, text_col: str, cutter, shards: int, salt: int) -> DataFrame:
    """Packed blocks of the distinct units, one row per task and part of a shard."""

    def blocks(counted: _Counted) -> pa.RecordBatch:
        keys, counts, lengths, data = counted.merge()
        cuts = np.searchsorted(shard_of(keys, shards * PARTS), np.arange(shards * PARTS + 1))
        begin = np.append(0, np.cumsum(lengths))
        rows = [(int(s) // PARTS, int(s) % PARTS, keys[a:b].tobytes(), counts[a:b].astype("<i8").tobytes(), lengths[a:b].astype("u1").tobytes(),
                 data[begin[a]:begin[b]].tobytes())
                for s, a, b in ((s, cuts[s], cuts[s + 1]) for s in np.flatnonzero(np.diff(cuts)))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int32()) for c in columns[:2]], *[pa.array(c, pa.binary()) for c in columns[2:]]],
            names=["shard", "part", "keys", "counts", "lengths", "data"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counted()
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in chunks(offsets):
                base = offsets[lo]
                raw = data[base:offsets[hi]]
                starts, ends, _ = cutter(raw, offsets[lo:hi + 1] - base)
                lengths = ends - starts
                fit = lengths <= LONGEST
                starts, lengths = starts[fit], lengths[fit]
                keys, first, n = np.unique(run_hashes(raw, starts, lengths, salt), return_index=True, return_counts=True)
                counted.add(keys, n, lengths[first], raw[spread(starts[first], lengths[first])])
                if counted.size > HELD:
                    counted.merge()
                    if counted.size > HELD // 2:
                        yield blocks(counted)
                        counted = _Counted()
        yield blocks(counted)

    return map_batches(docs.select(text_col), work, BLOCK)


def build(docs: DataFrame, text_col: str, cutter, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]]) -> UnitTable:
    """Count the units of ``docs`` and write the table of the frequent ones.

    ``encoder()`` is called on the workers and gives the ids (whole numbers below 2**32) of
    each of a list of units.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for salt in range(100):
        folder = local_folder(spark, "unit-table")

        def merged(counted: _Counted, salt: int = salt) -> tuple:
            """How many units of a part share another's hash; the frequent ones' hashes, numbers of ids, and ids."""
            raw = [np.concatenate(x) for x in zip(*counted.parts, strict=True)]
            begin = np.cumsum(raw[2]) - raw[2]
            second = run_hashes(raw[3], begin, raw[2], salt + 1000)
            order = np.lexsort((second, raw[0]))
            clash = int(((np.diff(raw[0][order]) == 0) & (np.diff(second[order]) != 0)).sum())
            keys, counts, lengths, data = counted.merge()
            begin = np.cumsum(lengths) - lengths
            kept = np.flatnonzero(counts >= LEAST)
            encode, ids, body = encoder(), [], data.tobytes()
            for lo in range(0, len(kept), 4096):
                part = kept[lo:lo + 4096].tolist()
                ids += encode([body[begin[i]:begin[i] + lengths[i]].decode() for i in part])
            return clash, (keys[kept], np.array([len(i) for i in ids], dtype=np.int64),
                           (np.concatenate(ids) if ids else np.empty(0)).astype("<u4"))

        def write(shard: int, parts: list[tuple], folder: str = folder) -> None:
            keys, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            _save(folder, f"k-{shard}", keys)
            _save(folder, f"o-{shard}", np.append(0, np.cumsum(sizes)).astype("<u4"))
            _save(folder, f"i-{shard}", ids)

        def run(batches: Iterator[pa.RecordBatch], merged=merged, write=write) -> Iterator[pa.RecordBatch]:
            current, counted, done, clashes = None, _Counted(), [], 0

            def close(shard: int | None) -> None:
                """End the current part, and the current shard unless the next part is of it."""
                nonlocal clashes, done
                clash, found = merged(counted)
                clashes += clash
                done.append(found)
                if shard != current[0]:
                    write(current[0], done)
                    done = []

            for b in batches:
                for shard, part, *packed in zip(*(b.column(i) for i in range(6)), strict=True):
                    now = (shard.as_py(), part.as_py())
                    if now != current:
                        if current is not None:
                            close(now[0])
                        current, counted = now, _Counted()
                    keys, counts, lengths, data = (np.frombuffer(p.as_buffer(), dtype=t) for p, t in
                                                   zip(packed, ("<u8", "<i8", "u1", "u1"), strict=True))
                    counted.add(keys, counts, lengths.astype(np.int64), data)
            if current is not None:
                close(None)
            yield pa.RecordBatch.from_arrays([pa.array([clashes], pa.int64())], names=["clashes"])

        blocks = count_units(docs, text_col, cutter, shards, salt)
        found = map_batches(blocks.repartition(shards, "shard").sortWithinPartitions("shard", "part"), run, "clashes long")
        if not found.agg(F.sum("clashes")).first()[0]:
            return UnitTable(folder, shards, salt, cutter)
    raise RuntimeError("no hash without a clash found")


@lru_cache(maxsize=4096)
def _array(folder: str, name: str, kind: str) -> np.ndarray:
    return _map(folder, name, kind)


def _look_up(table: UnitTable, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all found keys in order, how many each has, which were found); ``keys`` ascend."""
    found, sizes, parts = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64), []
    cuts = np.searchsorted(shard_of(keys, table.shards), np.arange(table.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        there, wanted = _array(table.folder, f"k-{s}", "<u8"), keys[cuts[s]:cuts[s + 1]]
        if not len(there):
            continue
        at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        hit = there[at] == wanted
        ends = _array(table.folder, f"o-{s}", "<u4")
        begin, end = ends[at[hit]].astype(np.int64), ends[at[hit] + 1].astype(np.int64)
        parts.append(_array(table.folder, f"i-{s}", "<u4")[spread(begin, end - begin)])
        found[cuts[s]:cuts[s + 1]], sizes[cuts[s]:cuts[s + 1]][hit] = hit, end - begin
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)), sizes, found


def text_ids(table: UnitTable, raw: np.ndarray, offsets: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of ids of each text); ``encode`` for what the table lacks."""
    starts, ends, first = table.cutter(raw, offsets)
    lengths = ends - starts
    fit = np.flatnonzero(lengths <= LONGEST)
    keys, one, back = np.unique(run_hashes(raw, starts[fit], lengths[fit], table.salt), return_index=True, return_inverse=True)
    ids, sizes, found = _look_up(table, keys)
    # distinct units: those of the table, then the rare ones, then every long one
    rare, long = fit[one[~found]], np.flatnonzero(lengths > LONGEST)
    missing = np.concatenate([rare, long])
    body = raw.tobytes() if len(missing) else b""
    more = encode([body[starts[i]:ends[i]].decode() for i in missing.tolist()]) if len(missing) else []
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate([ids, *more]).astype(np.uint32) if more else ids
    extra = np.array([len(m) for m in more], dtype=np.int64)
    extra_at = len(ids) + np.cumsum(extra) - extra
    begin[~found], sizes[~found] = extra_at[:len(rare)], extra[:len(rare)]
    unit_at, unit_size = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
    unit_at[fit], unit_size[fit] = begin[back], sizes[back]
    unit_at[long], unit_size[long] = extra_at[len(rare):], extra[len(rare):]
    upto = np.append(0, np.cumsum(unit_size))
    return flat[spread(unit_at, unit_size)], upto[first[1:]] - upto[first[:-1]]
