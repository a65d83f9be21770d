"""LM scoring (operator 1): an interpolated modified Kneser-Ney n-gram model.

Counting.  Every task turns its texts into n-grams of 64-bit word hashes (no
object per word), counts them and sends one packed block per shard of the hash
range; Spark shuffles the blocks, and one task per shard merges them.  An n-gram
of words is spread by the hash of all its words, so a frequent word or context
does not gather in one shard, and every block is counted before it is sent.

Model.  For each order k the shards hold sorted 64-bit n-gram hashes with their
counts (for k below the top: the number of distinct words seen before the
n-gram), and sorted context hashes with the context's total and back-off weight.
The discounts come from the counts of counts, four numbers per order:

    Y = n1 / (n1 + 2 n2),  D1 = 1 - 2 Y n2/n1,  D2 = 2 - 3 Y n3/n2,  D3+ = 3 - 4 Y n4/n3
    p(w | h) = (c(hw) - D(c)) / c(h) + gamma(h) p(w | h')
    gamma(h) = (D1 N1(h) + D2 N2(h) + D3+ N3+(h)) / c(h)

The lowest order is interpolated with 1 / (V + 1), which unknown words get too.
Where a count of counts is zero the discounts fall back to 0.5, 1 and 1.5.

Storage.  Every shard is a few arrays in the shared folder of
``spark.checkpoint.dir``; a worker maps them into memory, so its pages are
shared and only what is looked up is read.  Files are written under a name of
their own and renamed, so a task that runs twice leaves one file.  The folder
must be mounted on the workers; an object store is refused with an error.

Words: runs of bytes other than space and 0x09-0x0D after lower-casing A-Z, then
one end token per text; the contexts at a text's beginning hold start marks,
which are never predicted.

Defined results: a null text counts as empty (one end token); an empty training
set gives a model in which every token has probability 1; texts of any length
are counted and scored whole; repeated rows count as often as they occur.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.scratch import new_path, stored
from calibra.llm.text import U, chunks, mix, utf8, word_hashes

ORDER = 2
#: the hash of the end token and of the start mark; no word hashes to them but by chance
END, START = U(0xE3D0E3D0E3D0E3D1), U(0x57A2757A2757A275)
CHUNK = 2 << 20


def token_stream(data: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with ``pad`` start marks before and one end after each text, owner of each token)."""
    words, first = word_hashes(data, offsets)
    n = len(offsets) - 1
    sizes = np.diff(first) + pad + 1
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    begins = np.cumsum(sizes) - sizes
    tokens = np.empty(int(sizes.sum()), dtype=U)
    is_word = np.ones(len(tokens), dtype=bool)
    ends = begins + sizes - 1
    is_word[ends] = False
    for p in range(pad):
        is_word[begins + p] = False
        tokens[begins + p] = START
    tokens[ends] = END
    tokens[is_word] = words
    return tokens, owner


def ngrams(tokens: np.ndarray, owner: np.ndarray, pad: int, order: int) -> np.ndarray:
    """Rows of ``order`` tokens ending at every predicted token (words and ends)."""
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    predicted = np.ones(len(tokens), dtype=bool)
    for p in range(pad):
        predicted[at + p] = False
    last = np.flatnonzero(predicted)
    return np.stack([tokens[last - (order - 1 - i)] for i in range(order)], axis=1)


def key_of(rows: np.ndarray) -> np.ndarray:
    """One 64-bit hash per n-gram, spread over the whole range."""
    out = np.full(len(rows), U(rows.shape[1]), dtype=U)
    for i in range(rows.shape[1]):
        out = mix(out * U(0x9E3779B97F4A7C15) + rows[:, i])
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards cut the hash range into equal parts, in ascending order."""
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in hash order: (hashes, n-grams, summed counts)."""
    keys = key_of(rows)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[new], rows[order[new]], (np.add.reduceat(counts[order], new, axis=0) if len(new) else counts[:0])


def blocks(keys: np.ndarray, rows: np.ndarray, counts: np.ndarray, shards: int, kind: str) -> pa.RecordBatch:
    """One row per shard that has any: the n-grams and counts as packed bytes."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    out: dict = {"kind": [], "shard": [], "grams": [], "counts": []}
    for s in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[s], cuts[s + 1]
        out["kind"].append(kind)
        out["shard"].append(int(s))
        out["grams"].append(rows[lo:hi].tobytes())
        out["counts"].append(_narrow(counts[lo:hi]))
    return pa.RecordBatch.from_arrays(
        [pa.array(out["kind"], pa.string()), pa.array(out["shard"], pa.int32()),
         pa.array(out["grams"], pa.large_binary()).cast(pa.binary()), pa.array(out["counts"], pa.binary())],
        names=["kind", "shard", "grams", "counts"])


BLOCKS = "kind string, shard int, grams binary, counts binary"


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; the first byte is their width."""
    most = int(counts.max()) if counts.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


# --- counting ------------------------------------------------------------------------


class _Gather:
    """n-grams of a task, counted whenever they reach a bound, so memory stays bounded."""

    LIMIT = 2_000_000

    def __init__(self, order: int, fields: int = 1):
        self.rows, self.counts, self.size = [], [], 0
        self.order, self.fields = order, fields

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.rows.append(rows)
        self.counts.append(counts)
        self.size += len(rows)

    def full(self) -> bool:
        return self.size >= self.LIMIT

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.concatenate(self.rows) if self.rows else np.empty((0, self.order), dtype=U)
        counts = np.concatenate(self.counts) if self.counts else np.empty((0, self.fields), dtype=np.int64)
        self.rows, self.counts, self.size = [], [], 0
        return summed(rows, counts)


def count_blocks(docs: DataFrame, text_col: str, order: int, shards: int) -> DataFrame:
    """Counted n-grams of the top order and, as kind ``v``, plain token counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, plain = _Gather(order), _Gather(1)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in chunks(offsets, CHUNK):
                tokens, owner = token_stream(data, offsets[lo:hi + 1], order - 1)
                rows = ngrams(tokens, owner, order - 1, order)
                for gather, part in ((top, rows), (plain, rows[:, -1:])):
                    _, grams, counts = summed(part, np.ones((len(part), 1), dtype=np.int64))
                    gather.add(grams, counts)
                    if gather.full():
                        yield blocks(*gather.take(), shards, "t" if gather is top else "v")
        yield blocks(*top.take(), shards, "t")
        yield blocks(*plain.take(), shards, "v")

    return docs.select(text_col).mapInArrow(work, BLOCKS)


def merged(frame: DataFrame, shards: int, fields: dict[str, tuple[int, int]], work) -> DataFrame:
    """Merge the blocks of each (kind, shard) and hand the sums to ``work(kind, shard, keys, grams, counts)``.

    ``fields``: kind -> (words per n-gram, numbers per n-gram).  Blocks stream
    in; a shard's sums are all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gather = None, None

        def close():
            yield from work(*current, *gather.take())

        for b in batches:
            for kind, shard, grams, counts in zip(*(b.column(i) for i in range(4)), strict=True):
                now = (kind.as_py(), shard.as_py())
                if now != current:
                    if current is not None:
                        yield from close()
                    current, gather = now, _Gather(*fields[now[0]])
                words, numbers = fields[now[0]]
                gather.add(np.frombuffer(grams.as_buffer(), dtype=U).reshape(-1, words),
                           _wide(counts.as_py()).reshape(-1, numbers))
                if gather.full():
                    _, rows, sums = gather.take()
                    gather.add(rows, sums)
                    gather.LIMIT = max(_Gather.LIMIT, 2 * len(rows))
        if current is not None:
            yield from close()

    return frame.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(run, OUTPUT)


#: what a merging task returns: blocks for the next order, or numbers about the shard
OUTPUT = "kind string, shard int, grams binary, counts binary"


# --- files ---------------------------------------------------------------------------


def _save(folder: str, name: str, array: np.ndarray) -> None:
    path = os.path.join(folder, name)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with open(attempt, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(attempt, path)


#: names of files that hold whole numbers in 1, 2, 4 or 8 bytes each
WIDTHS = ("u1", "u2", "u4", "u8")


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in the fewest bytes that hold the shard's greatest; the file's name says how many."""
    most = int(counts.max()) if len(counts) else 0
    width = next(w for w in WIDTHS if most < 1 << (8 * int(w[1:])))
    _save(folder, f"{name}.{width}", counts.astype(f"<{width}"))


def _map_counts(folder: str, name: str) -> np.ndarray:
    width = next((w for w in WIDTHS if os.path.exists(os.path.join(folder, f"{name}.{w}"))), "u1")
    return _map(folder, f"{name}.{width}", f"<{width}")


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    path = os.path.join(folder, name)
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder, as a path that workers can map."""
    path = new_path(spark, name)
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder to map a model from it, not {scheme}:")
    folder = "/" + rest.lstrip("/")
    os.makedirs(folder, exist_ok=True)
    return folder


# --- training ------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What a worker needs besides the mapped files: a few numbers."""

    folder: str
    order: int
    shards: int
    tokens: int                              # N
    vocabulary: int                          # V
    discounts: tuple[tuple[float, ...], ...]  # per order 1..n: D1, D2, D3+
    lowest: tuple[float, float]              # total and back-off weight of the empty context


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def _stats(kind: str, shard: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of counts 1 to 4, number of n-grams and their sum, as one row."""
    row = [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]
    return pa.RecordBatch.from_arrays(
        [pa.array([f"s{kind}"], pa.string()), pa.array([shard], pa.int32()), pa.array([b""], pa.binary()),
         pa.array([np.array(row, dtype=np.int64).tobytes()], pa.binary())],
        names=["kind", "shard", "grams", "counts"])


def _totals(rows: DataFrame, kind: str) -> list[int]:
    """Sums over the shards (one row of six numbers each)."""
    found = [np.frombuffer(bytes(r["counts"]), dtype=np.int64)
             for r in rows.where(F.col("kind") == f"s{kind}").select("counts").collect()]
    return np.sum(found, axis=0).tolist() if found else [0] * 6


def _context_parts(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context (all words but the last): total count, and how many n-grams have count 1, 2, 3+."""
    c = counts[:, 0]
    parts = np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.int64)
    return summed(rows[:, :-1], parts)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count the documents and write the model's arrays."""
    if order < 2:
        raise ValueError("the order must be at least 2")
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_folder(spark, "ngram-lm")

    def keep(k: int):
        """Write the shard's n-grams of order k; send on its contexts and its shorter n-grams."""

        def work(kind, shard, keys, rows, counts):
            if kind == "v":
                # plain token counts: N, V and the known words
                _save(folder, f"v-{shard}", keys)
                _save(folder, f"vc-{shard}", counts[:, 0].astype(np.int64))
                yield _stats(kind, shard, counts[:, 0])
                return
            if kind == "c":
                # contexts of the order above: their totals and numbers of n-grams by count
                _save(folder, f"x{k + 1}-{shard}", keys)
                _save(folder, f"xn{k + 1}-{shard}", counts.astype(np.int64))
                return
            _save(folder, f"g{k}-{shard}", keys)
            _save_counts(folder, f"c{k}-{shard}", counts[:, 0])
            yield _stats(kind, shard, counts[:, 0])
            if k > 1:
                yield blocks(*_context_parts(rows, counts), shards, "c")
                # distinct words before the shorter n-gram: its count in the order below
                yield blocks(*summed(rows[:, 1:], np.ones((len(rows), 1), dtype=np.int64)), shards, "t")

        return work

    level = merged(count_blocks(docs, text_col, order, shards), shards, {"t": (order, 1), "v": (1, 1)}, keep(order))
    found, tokens, vocabulary, lowest = [], 0, 0, (1.0, 1.0)
    for k in range(order, 0, -1):
        done = stored(level, f"lm-order{k}")
        if k == order:
            *_, vocabulary, tokens = _totals(done, "v")
        *counts, grams, total = _totals(done, "t")
        found.append(discounts(*counts))
        if k > 1:
            level = merged(done.where(F.col("kind").isin("t", "c")), shards, {"t": (k - 1, 1), "c": (k - 1, 4)},
                           keep(k - 1))
        elif total:
            n1, n2 = counts[:2]
            d = found[-1]
            lowest = (float(total), (d[0] * n1 + d[1] * n2 + d[2] * (grams - n1 - n2)) / total)
    return Model(folder, order, shards, int(tokens), int(vocabulary), tuple(reversed(found)), lowest)


# --- scoring -------------------------------------------------------------------------


#: kind of an array whose files say how wide its numbers are
COUNTS = "counts"


class Lookup:
    """The mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model

    @lru_cache(maxsize=None)  # noqa: B019  (one object per worker and model)
    def part(self, name: str, shard: int, dtype: str) -> np.ndarray:
        if dtype == COUNTS:
            return _map_counts(self.model.folder, f"{name}-{shard}")
        return _map(self.model.folder, f"{name}-{shard}", dtype)

    def find(self, name: str, value: str, keys: np.ndarray, dtype: str, width: int = 1) -> np.ndarray:
        """Values of the keys (ascending); 0 where a key is not there."""
        out = np.zeros((len(keys), width), dtype=np.int64)
        cuts = np.searchsorted(shard_of(keys, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            wanted = keys[cuts[s]:cuts[s + 1]]
            there = self.part(name, s, "<u8")
            if not len(there):
                continue
            at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
            hit = there[at] == wanted
            values = self.part(value, s, dtype).reshape(-1, width)
            out[cuts[s]:cuts[s + 1]][hit] = values[at[hit]]
        return out

    def of(self, name: str, value: str, rows: np.ndarray, dtype: str, width: int = 1) -> np.ndarray:
        keys, back = np.unique(key_of(rows), return_inverse=True)
        return self.find(name, value, keys, dtype, width)[back]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """p(last | words before) of each row, interpolated from the lowest order up."""
        m = self.model
        p = np.full(len(rows), 1.0 / (m.vocabulary + 1))
        for k in range(1, m.order + 1):
            part = rows[:, m.order - k:]
            c = self.of(f"g{k}", f"c{k}", part, COUNTS)[:, 0]
            d = np.array([0.0, *m.discounts[k - 1]])
            own = c - d[np.minimum(c, 3)]
            if k == 1:
                total, weight = m.lowest
                p = own / total + weight * p
                continue
            x = self.of(f"x{k}", f"xn{k}", part[:, :-1], "<i8", 4)
            total = np.maximum(x[:, 0], 1)
            weight = np.where(x[:, 0] > 0, (x[:, 1:] @ d[1:]) / total, 1.0)
            p = own / total + weight * p
        return p


_lookups: dict[str, Lookup] = {}


def lookup(model: Model) -> Lookup:
    """One set of mapped arrays per worker and model; those of another model are let go."""
    if model.folder not in _lookups:
        _lookups.clear()
        _lookups[model.folder] = Lookup(model)
    return _lookups[model.folder]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens, n_known, train_tokens, base_score, score, perplexity``; columns
    of these names are replaced."""
    added = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(),
             "score": pa.float64(), "perplexity": pa.float64()}
    docs = docs.drop(*added)
    schema = docs.select("*", *[F.lit(0).cast("double" if t == pa.float64() else "long").alias(c)
                                for c, t in added.items()]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup(model)
        for b in batches:
            data, offsets = utf8(b.column(b.schema.get_field_index(text_col)))
            columns: dict[str, list[np.ndarray]] = {c: [] for c in added}
            for lo, hi in chunks(offsets, CHUNK):
                n = hi - lo
                tokens, owner = token_stream(data, offsets[lo:hi + 1], model.order - 1)
                rows = ngrams(tokens, owner, model.order - 1, model.order)
                of = np.repeat(np.arange(n), np.bincount(owner, minlength=n) - (model.order - 1))
                c = find.of("v", "vc", rows[:, -1:], "<i8")[:, 0]
                base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
                total = np.bincount(of, weights=np.log10(find.probability(rows)), minlength=n)
                size = np.bincount(of, minlength=n)
                columns["n_tokens"].append(size)
                columns["n_known"].append(np.bincount(of, weights=c > 0, minlength=n).astype(np.int64))
                columns["train_tokens"].append(np.full(n, model.tokens))
                columns["base_score"].append(np.bincount(of, weights=base, minlength=n))
                columns["score"].append(total)
                columns["perplexity"].append(10.0 ** np.minimum(-total / size, 300))
            arrays = [pa.array(np.concatenate(columns[c]) if columns[c] else [], t) for c, t in added.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *added])

    return docs.mapInArrow(work, schema)
