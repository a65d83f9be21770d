"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Used inside tasks: a batch's texts are cut into chunks of bounded bytes, words
become 64-bit hashes without making a Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: bytes of a batch that Spark hands to a task's Python, and the setting that bounds them
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: glibc's malloc_trim; None with another C library
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
U = np.uint64

# white space of the word rule: space and 0x09-0x0D; only A-Z are lower-cased
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offs


def give_back() -> None:
    """Freed memory of this process that Arrow and glibc hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def map_batches(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema) -> DataFrame:
    """``frame.mapInArrow`` in bounded memory.

    Spark's batches are cut at ``BATCH_BYTES`` as well as by row count, so very long texts do not
    add up (the session's own setting wins where there is one; a longer text is a batch of its
    own).  The memory that Arrow and the C library keep for reuse is given back after every batch and
    task: Python workers live on from task to task beside the executor's heap.
    """
    spark = frame.sparkSession
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in work(batches):
            yield b
            give_back()
        give_back()

    return frame.mapInArrow(run, schema)


def chunks(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``max_bytes`` of text each; a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64); a bijection."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_GOLDEN = 0x9E3779B97F4A7C15
_powers = np.empty(0, dtype=U)


def _position_keys(n: int) -> np.ndarray:
    """One pseudo-random 64-bit multiplier per position inside a word (grown on demand)."""
    global _powers
    if len(_powers) < n:
        size = max(n, 1024, 2 * len(_powers))
        _powers = mix(np.arange(1, size + 1, dtype=U) * U(_GOLDEN))
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and each text's first word index.

    ``offsets`` are byte offsets into ``data`` (n + 1 of them).  Words are runs
    of bytes other than space and 0x09-0x0D, lower-cased in A-Z; a text's end
    ends its last word.  Returns (hashes, first) with ``first`` of length n + 1.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    raw = data[base:end]
    inside = ~IS_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = (offsets[:-1] - base)
    cuts = cuts[cuts < len(raw)]
    start[cuts] = inside[cuts]
    letters = LOWER[raw[inside]]
    starts = np.flatnonzero(start[inside])           # word starts among the letters
    begins = np.flatnonzero(start)                   # word starts among the bytes
    first = np.searchsorted(begins, offsets - base, side="left")
    if not len(starts):
        return np.empty(0, dtype=U), first
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    keys = _position_keys(int(lengths.max()))
    values = (letters.astype(U) + U(1)) * keys[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(U) * U(_GOLDEN)), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` successive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    out = np.zeros(max(m, 0), dtype=U)
    for i in range(n):
        out += words[i:i + m] * U(mix(np.array([2 * i + 1], dtype=U))[0] | U(1))
    return mix(out)
