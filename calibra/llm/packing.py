"""Best-fit packing (operator 3) with the Martello-Toth dominance reduction.

Documents become token ids plus one end id; only documents longer than the
capacity are cut, into full pieces and a rest.  Which pieces share a sequence
depends on their lengths alone, so the instance is a *histogram*: how many
pieces there are of each length 1..capacity.  It has at most ``capacity`` rows,
whatever the corpus, and is solved with multiplicities:

1. Dominance reduction.  For the longest remaining length ``w``: if some feasible
   set of at most three pieces with ``w`` in it dominates every other feasible set
   with ``w``, an optimal packing exists that uses it, so it is fixed for good (at
   once for as many pieces as there are) and the instance shrinks.
   - nothing else fits beside ``w``: {w};
   - a length fits exactly, or at most one more piece can fit: {w, longest that fits};
   - at most two more can fit and no pair sums to more than that longest single: the
     same; a pair whose members are the longest first and second choice: {w, a, b}.
2. What remains goes best-fit decreasing: each length into the open sequences with
   the least room that still holds it, opening new ones when none does.

The solution is a list of patterns (lengths) with multiplicities.  Token ids come from a table of the corpus' frequent words, each encoded once and
mapped into memory by the workers (:mod:`calibra.llm.unit_table`).  Spark then
numbers the pieces of each length and looks every number up in the patterns:
sequence ids and offsets are assigned without any sequence or length being
gathered in one task (numbers within a length come from salted shares and their
offsets).

Defined results: a null text counts as empty (one end id); an empty table gives
an empty result; null ids are kept; repeated rows are packed as rows of their
own; ties between pieces of one length are broken by any order, which changes
neither the number of sequences nor their fill.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.frames import few_rows
from calibra.llm import unit_table
from calibra.llm.scratch import free_name, stored
from calibra.llm.text import chunks, map_batches, utf8

CAPACITY = 2048
END_ID = 0
#: the mark between words that are encoded together
MARK = "~"


# --- token ids ---------------------------------------------------------------------


class _Encoder:
    """Ids of words, which this vocabulary never joins: it drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark runs one task per core: threads inside a task would only compete
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True      # their strings in a text are ordinary text
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word.  Short words are encoded many at a time with a mark between them; a
        mark stands alone between spaces, so it is one id that no other word can give."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if MARK not in w and len(w) <= unit_table.LONGEST]
        for lo in range(0, len(plain), 256):
            part = plain[lo:lo + 256]
            ids = np.array(self.tok.encode(f" {MARK} ".join([words[i] for i in part]), add_special_tokens=False).ids,
                           dtype=np.uint32)
            for i, one in zip(part, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                out[i] = one
            # every part but the first begins with the mark
            for i in part[1:]:
                out[i] = out[i][1:]
        for i, one in enumerate(out):
            if one is None:
                out[i] = np.array(self.tok.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def word_table(docs: DataFrame, path: str, text_col: str = "text") -> unit_table.UnitTable:
    """The ids of the documents' frequent words; a word's ids do not depend on the words beside it."""
    return unit_table.build(docs, text_col, unit_table.word_runs, lambda: _encoder(path).words)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as bytes if asked for)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    table = word_table(source, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).words
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in chunks(offsets):
                raw = data[offsets[lo]:offsets[hi]]
                ids, sizes = unit_table.text_ids(table, raw, offsets[lo:hi + 1] - offsets[lo], encode)
                # one end id after each text
                ids = np.insert(ids, np.cumsum(sizes), END_ID).astype("<u4")
                sizes = sizes + 1
                begin = np.cumsum(sizes) - sizes
                count = -(-sizes // capacity)
                at = np.repeat(np.arange(hi - lo), count)
                number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(sizes[at] - start, capacity)
                body, first = ids.tobytes(), 4 * (begin[at] + start)
                own = [body[f:f + 4 * n] for f, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [b.column(0).slice(lo, hi - lo).take(pa.array(at)), pa.array(number.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array([zlib.crc32(o) for o in own], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(source, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                       + (", ids binary" if with_ids else ""))


# --- the instance: a histogram of lengths ------------------------------------------


class _Counts:
    """How many pieces of each length remain; the lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.lengths = sorted(self.n)

    def take(self, w: int, count: int) -> None:
        self.n[w] -= count
        if not self.n[w]:
            del self.n[w]
            self.lengths.pop(bisect_left(self.lengths, w))

    def longest(self, room: int, besides: dict[int, int]) -> int:
        """The longest length of at most ``room`` with a piece left besides those; 0 if none."""
        i = bisect_left(self.lengths, room + 1) - 1
        while i >= 0:
            w = self.lengths[i]
            if self.n[w] > besides.get(w, 0):
                return w
            i -= 1
        return 0

    def smallest(self, count: int, besides: dict[int, int]) -> list[int]:
        """The ``count`` smallest pieces left besides those (fewer if there are not as many)."""
        out: list[int] = []
        for w in self.lengths:
            out += [w] * min(count - len(out), self.n[w] - besides.get(w, 0))
            if len(out) == count:
                break
        return out


def dominant_set(left: _Counts, w: int, capacity: int) -> list[int] | None:
    """Pieces beside ``w`` in a set that dominates all feasible sets with ``w``; None if unsure."""
    room, used = capacity - w, {w: 1}
    first = left.longest(room, used)
    if not first or first == room:
        return [first] if first else []
    low = left.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > room:
        return [first]                                     # at most one more piece can fit
    if len(low) == 3 and sum(low) <= room:
        return None                                        # three or more may fit
    # at most two more: the best pair that fits, and the pair that begins with the longest
    best = 0
    for a in left.lengths:
        if a >= room:
            break
        if left.n[a] > used.get(a, 0):
            b = left.longest(room - a, {w: 1, a: 1 + used.get(a, 0)} if a != w else {w: 2})
            best = max(best, a + b if b else 0)
    if first >= best:
        return [first]
    second = left.longest(room - first, {w: 1, first: 1 + used.get(first, 0)} if first != w else {w: 2})
    # {first, second} dominates a pair (a, b), a >= b, if a <= first and b <= second
    half = left.longest(room // 2, used)
    if second and half <= second:
        return [first, second]
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """(fixed patterns with multiplicity, the remaining histogram)."""
    left, fixed = _Counts(counts), []
    for w in sorted(counts, reverse=True):
        while left.n.get(w):
            others = dominant_set(left, w, capacity)
            if others is None:
                break
            pattern = [w, *others]
            need = {x: pattern.count(x) for x in pattern}
            times = min(left.n[x] // c for x, c in need.items())
            # the choice stays the same while every length in it, and the smallest ones that
            # bound the number of pieces, last: those are looked at again after this many
            times = max(1, times)
            for x, c in need.items():
                left.take(x, c * times)
            fixed.append((pattern, times))
    return fixed, left.n


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with multiplicity; equal lengths are placed many at a time."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}     # room left -> (pattern, how many)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], many: int) -> None:
        if many:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, many))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, pattern, many = capacity, (), -(-n // (capacity // w))
            # a sequence that has just taken one has the least room: it is filled on
            each = room // w
            full = min(many, n // each)
            put(room - each * w, pattern + (w,) * each, full)
            n -= full * each
            many -= full
            if many and n:
                put(room - n * w, pattern + (w,) * n, 1)
                many, n = many - 1, 0
            if many and pattern:
                put(room, pattern, many)
    return [(list(p), m) for g in groups.values() for p, m in g]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns with multiplicities that pack the whole histogram."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


# --- assignment ---------------------------------------------------------------------


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number + 1, sequence of the first, offset) of every place."""
    out, taken, sequence = [], {}, 0
    for lengths, many in patterns:
        offset = 0
        for w in lengths:
            at = taken.get(w, 0)
            out.append((w, at, at + many, sequence, offset))
            taken[w] = at + many
            offset += w
        sequence += many
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``items`` must read the same each time (a stored table).
    """
    spark = items.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not w or not 0 < w <= capacity for w in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    table = slots(solve(counts, capacity))
    # numbers within a length: dealt to shares by a hash, numbered there, moved by the shares before
    keys = [c for c in items.columns if c != "length"]
    share, k, here, before_ = (free_name(items, n) for n in ("share", "number", "slots", "before"))
    dealt = items.withColumn(share, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), F.lit(shares)))
    before = dealt.groupBy("length", share).agg(F.count(F.lit(1)).alias("_n")).select(
        "length", share, (F.sum("_n").over(Window.partitionBy("length").orderBy(share)) - F.col("_n")).alias(before_))
    order = Window.partitionBy("length", share).orderBy(*[F.col(f"`{c}`") for c in keys])
    numbered = dealt.withColumn(k, F.row_number().over(order) - 1).join(before, ["length", share]) \
        .withColumn(k, F.col(k) + F.col(before_))
    # the slots of a length, of which a number fits exactly one
    names = "length long, first long, last long, sequence long, place long"
    by_length = few_rows(spark, table or [], names).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "sequence", "place"))).alias(here))
    found = numbered.join(F.broadcast(by_length), "length") \
        .withColumn(here, F.filter(here, lambda s: (s["first"] <= F.col(k)) & (F.col(k) < s["last"]))[0])
    return found.select(*[F.col(f"`{c}`") for c in items.columns],
                        (F.col(f"{here}.sequence") + F.col(k) - F.col(f"{here}.first")).alias("sequence_id"),
                        F.col(f"{here}.place").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """All pieces of the documents with their sequence and place in it."""
    return pack(stored(pieces(docs, path, id_col, text_col, capacity), "pieces"), capacity)
