"""Byte-level BPE encoding and decoding (operator 7).

Bytes are mapped to Latin-1 characters, so pyahocorasick (which reads strings)
finds all vocabulary entries of a piece in one pass.  Encoding walks the piece
from left to right with the longest entry at each place; an entry is accepted
only if it is *compatible* with the one before it, that is, if the exact merge
order would really leave this boundary.  If not, the next shorter entry is
tried, and when none is left the walk backs up; a bit per place that is known
to be a dead end keeps the whole walk linear.  Compatibility of two adjacent
tokens depends on nothing else, so it is memoised.  The result equals the exact
merges.

Texts are first cut by the tokenizer's pattern.  A space after a character that is
no white space always begins a piece of such a pattern, so texts are cut there;
the cuts that are frequent in the corpus are encoded once, and texts look their ids
up in a table that workers map into memory (:mod:`calibra.llm.unit_table`).

Defined results: a null text counts as empty and has no ids; decoding unknown
ids raises an error; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import unit_table
from calibra.llm.text import chunks, map_batches, utf8
from calibra.llm.unit_table import spread

#: entries of a worker's table of compatible neighbours
PAIR_ENTRIES = 1_000_000


#: white space beside white space
TOUCHING = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks = read_ranks(path)
        self.tokens: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._flat: tuple | None = None
        self._compatible: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        # a token's parts in the last merge that makes it; single bytes are their own parts
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            pair = self._last_merge(token, rank) if len(token) > 1 else None
            self.parts[rank] = pair or (rank, rank)
            if pair:
                self.merged[pair] = rank

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges below ``rank`` leave of a token, if they leave two."""
        parts = [self.ranks[token[i:i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [self.ranks.get(self.tokens[a] + self.tokens[b], rank) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(pairs)
            if best >= rank:
                return None
            i = pairs.index(best)
            parts[i:i + 2] = [best]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the exact merges leave ``left`` and ``right`` side by side.

        The merges that build the two tokens are undone, latest first; if at any
        moment the two that touch would have merged before the next of them, the
        boundary would not have survived.
        """
        known = self._compatible.get((left, right))
        if known is not None:
            return known
        a, b, before, result = left, right, 1 << 62, True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                result = False
                break
            # undo the later of the two merges; at equal ranks the left one came first
            if a > b:
                before, (_, part) = a, self.parts[a]
                if part != a:
                    a = part
                    continue
                before, (part, _) = b + 1, self.parts[b]
                if part == b:
                    break
                b = part
            else:
                before, (part, _) = b + 1, self.parts[b]
                if part != b:
                    b = part
                    continue
                before, (_, part) = a, self.parts[a]
                if part == a:
                    break
                a = part
        self._compatible[(left, right)] = result
        return result

    def _next_shorter(self, rank: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        found = self._shorter.get(rank)
        if found is None:
            token = self.tokens[rank]
            found = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)
            self._shorter[rank] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, text = len(piece), piece.decode("latin-1")
        # the walk that never has to try a shorter entry: longest entries all along
        greedy = [rank for _, (_, rank) in self.automaton.iter_long(text)]
        known = self._compatible
        for pair in zip(greedy, greedy[1:], strict=False):
            fits = known.get(pair)
            if fits is None:
                fits = self.compatible(*pair)
            if not fits:
                break
        else:
            if sum([len(self.tokens[g]) for g in greedy]) == n:
                return greedy
        longest = [-1] * n
        for end, (length, rank) in self.automaton.iter(text):
            longest[end - length + 1] = rank        # ends ascend: the last one is the longest
        tokens, out, open_place = self.tokens, [], bytearray(b"\x01") * (n + 1)
        compatible, shorter = self.compatible, self._next_shorter
        at, token = 0, longest[0]
        while True:
            end = at + len(tokens[token])
            if open_place[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter(token)
            if token < 0:
                open_place[at] = 0
                token = out.pop()
                at -= len(tokens[token])

    def encode_cut(self, cut: str) -> np.ndarray:
        """Ids of a text or a part of one, piece by piece of the pattern."""
        out: list[int] = []
        for piece in self.pattern.findall(cut):
            out += self.encode_piece(piece.encode())
        if len(self._compatible) > PAIR_ENTRIES:
            self._compatible.clear()
        return np.array(out, dtype=np.uint32)

    def cuts(self, cuts: list[str]) -> list[np.ndarray]:
        """Ids of each of many parts that no piece reaches over."""
        return [self.encode_cut(c) for c in cuts]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit numbers."""
        return np.concatenate([np.empty(0, np.uint32), *self.cuts(safe_cuts(text))]).astype("<u4").tobytes()

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that many ids stand for, one after another."""
        if self._flat is None:
            sizes = np.zeros(max(self.tokens, default=-1) + 1, dtype=np.int64)
            for rank, token in self.tokens.items():
                sizes[rank] = len(token)
            body = b"".join(self.tokens.get(r, b"") for r in range(len(sizes)))
            self._flat = (np.frombuffer(body, dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        body, begin, sizes = self._flat
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(sizes) or not sizes[ids].all()):
            raise KeyError("an id that the vocabulary does not hold")
        return body[spread(begin[ids], sizes[ids])]

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id's token (after ``joined``)."""
        return self._flat[2][ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def safe_cuts(text: str) -> list[str]:
    """Cut before every single space between two characters that are no white space.

    Such a space can only be the first character of a piece, so the pieces of
    the cuts are the pieces of the text.
    """
    parts = text.split(" ")
    if not TOUCHING.search(text) and parts[0] and parts[-1]:
        return [parts[0], *[" " + p for p in parts[1:]]]
    out = [parts[0]] if parts[0] else []
    for part in parts[1:]:
        # a part that is empty or touches other white space belongs to a run: join it
        if out and part and not part[0].isspace() and not out[-1][-1].isspace():
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> BytePairs:
    """One encoder per Python worker and rank file."""
    return BytePairs(path, pattern)


def cut_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> unit_table.UnitTable:
    """The ids of the documents' frequent cuts."""
    return unit_table.build(docs.select(F.col(text_col).cast("string").alias(text_col)), text_col, unit_table.spaced_runs,
                            lambda: tokenizer(path, pattern).cuts)


def _coded(table, pairs: BytePairs, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids of these texts one after another, number of ids of each)."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        yield lo, hi, *unit_table.text_ids(table, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], pairs.cuts)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of each text (array of int); the file must lie at ``path`` on the workers."""
    docs = docs.drop(ids_col)
    schema = docs.select("*", F.array(F.lit(0)).alias(ids_col)).schema
    table = cut_table(docs, path, pattern, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path, pattern)
        for b in batches:
            for lo, hi, ids, sizes in _coded(table, pairs, b.column(b.schema.get_field_index(text_col))):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)),
                                                             pa.array(ids.astype(np.int32)))],
                    names=[*part.schema.names, ids_col])

    return map_batches(docs, work, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary); null ids give empty bytes."""
    rows = rows.drop(bytes_col)
    schema = rows.select("*", F.lit(b"").alias(bytes_col)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path, pattern)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col))
            found = [pairs.joined(x.values.to_numpy()).tobytes() if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, bytes_col])

    return map_batches(rows, work, schema)


DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids again in one pass: ``docs`` without the text, with the number
    of ids and the digests of the ids (decimal, joined by one space) and of the decoded bytes."""
    kept = [c for c in docs.columns if c != text_col and c.lower() not in DIGESTS]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
                         F.lit("").alias("decoded_sha256")).schema
    table = cut_table(docs, path, pattern, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path, pattern)
        # every id as a decimal number and a space, cut out of one buffer
        names = [b"%d " % i for i in range(max(pairs.tokens, default=-1) + 1)]
        letters, width = np.frombuffer(b"".join(names), dtype=np.uint8), np.array([len(n) for n in names], dtype=np.int64)
        place = np.cumsum(width) - width
        for b in batches:
            for lo, hi, ids, sizes in _coded(table, pairs, b.column(b.schema.get_field_index(text_col))):
                part, upto = b.slice(lo, hi - lo), np.append(0, np.cumsum(sizes))
                out = []
                for body, length in ((letters[spread(place[ids], width[ids])], width[ids]), (pairs.joined(ids), pairs.sizes(ids))):
                    ends = np.append(0, np.cumsum(length))[upto].tolist()
                    drop = 1 if not out else 0        # the space after the last id
                    view = memoryview(body)
                    out.append([hashlib.sha256(view[x:max(x, y - drop)]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(sizes, pa.int64()),
                     *[pa.array(o, pa.string()) for o in out]], names=[*kept, *DIGESTS])

    return map_batches(docs, work, schema)


def id_text(ids_col: str = "ids") -> F.Column:
    """The ids as decimal numbers joined by one space."""
    return F.array_join(F.col(ids_col).cast("array<string>"), " ")
