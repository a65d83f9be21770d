"""Cross-tokenizer alignment (operator 12): an associative monoid of text fragments.

Two tokenizers read the same bytes: A, a byte-level BPE, and B, a sentencepiece model
that puts a space before the text (so A reads space + text).  Byte offsets where a
token of both ends cut the two token streams into groups.  A fragment holds what a
byte range of a document tells about that:

    open prefix     tokens up to and with the first common end (its group may begin before)
    closed groups   whole groups between common ends
    open suffix     tokens after the last common end (its group goes on)

Neighbouring fragments compose: the left one's suffix and the right one's prefix are
one group, and where a fragment has no common end at all its tokens join the
neighbour's open part.  Composition is associative, so the fragments of a very long
document are encoded in different tasks and composed in a tree.  Only open parts
travel up the tree; every group that a composition closes is written at once with
its place, and a document's digest is streamed over bodies and such joints in order.

Byte ranges begin wherever a multiple of ``RANGE`` falls, mostly inside a word.  Each
task encodes its range together with the text around it up to the next places where
both tokenizers certainly end a token: a space after a character that isn't white
space.  It keeps the tokens that end inside the range.  Where no such place is near,
the range is stretched to one, so the surplus stays below a quarter of a range.

Shorter texts are whole.  They are cut at such places as well: what lies between two of
them is a unit whose tokens and groups depend on nothing else, so the corpus' frequent units
are encoded and aligned once and texts look them up in a table that workers map into
memory (:mod:`calibra.llm.unit_table`).  Both tokenizers read the rarer and the longer units
where they stand.

Counts of linked id pairs are summed over the corpus (first in every task), written
as sorted arrays to the shared folder, and mapped by workers to look up each
document's links.  Their number is bounded by the product of the vocabularies.

Defined results: a null or empty text, and one whose tokens' bytes differ from space +
text (say, one that holds U+2581), has no tokens: zeros and the empty string; every row
gives one row, also with repeated or null ids; the row's other columns are kept, those
that have a result column's name are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import unit_table
from calibra.llm.ngram_lm import _map, _save, local_folder
from calibra.llm.scratch import free_name, stored
from calibra.llm.text import chunks, map_batches, utf8
from calibra.llm.unit_table import Runs, UnitTable, spaced_runs, spread

#: bytes of a range of a long document; texts up to twice of it are one fragment
RANGE = 1 << 15
#: how many neighbouring fragments one step of the tree composes
FAN_IN = 16
#: distinct pairs that a counting task holds before it hands them on
HELD = 1_000_000
#: white space in such a run overflows the stack of the fast encoder's pattern matcher
LONG_BLANK = re.compile(r"\s{4096}")
#: characters of neighbouring units that the tokenizers read at once
JOINED = 2048
#: marks on an id in written order: it is B's; it is the last one of its side of a group
SIDE, LAST = 1 << 31, 1 << 30
#: the ids themselves, and what stands for a unit whose bytes a tokenizer does not give back
ID, BAD = LAST - 1, (1 << 32) - 1


# --- the two tokenizers ------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers with the bytes of their tokens; one per worker and pair of files."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path_a}: a byte-level BPE without a normalizer is needed")
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path_a}: ids do not follow the order of merges")
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.sp.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        # whether no token of B reaches over a space that follows another character
        self.cuttable = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        # decimal ids by their marks, with what follows them: "," inside a side, "|" after A's side, ";" after B's
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        names = [b"%d%c" % (i, e) for e in b",|,;" for i in range(self.most)]
        self.letters, self.width = np.frombuffer(b"".join(names), dtype=np.uint8), np.array([len(n) for n in names])
        self.place = np.cumsum(self.width) - self.width

    def _piece(self, i: int) -> bytes:
        piece = self.sp.id_to_piece(i)
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A on space + text and of B on text; None unless both give the bytes back."""
        a, b = self.encode_a(" " + text), self.sp.encode([text], num_threads=1)[0]
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def cuts(self, units: list[str]) -> list[np.ndarray]:
        """Marked ids of each of many units, all of which begin with a space; ``BAD`` alone where bytes differ."""
        out, lo, size = [], 0, 0
        for hi, unit in enumerate(units, 1):
            size += len(unit)
            # white space at a unit's end would go on in the next one
            if size >= JOINED or hi == len(units) or unit[-1].isspace() or not self.cuttable:
                out += self._read(units[lo:hi])
                lo, size = hi, 0
        return out

    def _read(self, units: list[str]) -> list[np.ndarray]:
        """``cuts`` of units that are read as one text."""
        found = self.both("".join(units)[1:])
        if found is None:
            half = len(units) // 2
            return self._read(units[:half]) + self._read(units[half:]) if half else [np.array([BAD], dtype=np.uint32)]
        a, b = found
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        stream = marked(a, b, *aligned(a, ends_a, b, ends_b))
        ends = np.cumsum([len(u.encode()) for u in units])[:-1]
        return np.split(stream, np.searchsorted(ends_a, ends) + np.searchsorted(ends_b, ends) + 2)

    def text(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, length of each id's name) of marked ids as they are written."""
        at = (stream >> 30).astype(np.int64) * self.most + (stream & ID)
        width = self.width[at]
        return self.letters[spread(self.place[at], width)], width

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number per id pair."""
        return a * len(self.bytes_b) + b


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


# --- fragments ---------------------------------------------------------------------------

NONE = np.empty(0, dtype=np.int64)


@dataclass
class Fragment:
    """A byte range's open ends; ``first`` is the range that holds its first common end (-1: none)."""

    prefix: tuple[np.ndarray, np.ndarray] = (NONE, NONE)
    suffix: tuple[np.ndarray, np.ndarray] = (NONE, NONE)
    first: int = -1
    #: groups closed by composing, as (range whose body they precede, A's ids, B's ids)
    joints: list = field(default_factory=list)


def _join(x: tuple, y: tuple) -> tuple:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; ``Fragment()`` is neutral."""
    joints = left.joints + right.joints
    if left.first < 0:
        # nothing is closed on the left: its tokens open the right one's prefix
        if right.first < 0:
            return Fragment(_join(left.prefix, right.prefix), (NONE, NONE), -1, joints)
        return Fragment(_join(left.prefix, right.prefix), right.suffix, right.first, joints)
    if right.first < 0:
        return Fragment(left.prefix, _join(left.suffix, right.prefix), left.first, joints)
    return Fragment(left.prefix, right.suffix, left.first,
                    joints + [(right.first, *_join(left.suffix, right.prefix))])


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
    """(places in A, places in B) of the tokens at common ends; both streams in order."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)


def marked(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """The ids of whole groups in written order, with their marks.

    ``at_a, at_b``: places of the groups' last tokens; both streams end with the last group.
    """
    parts = np.empty(len(a) + len(b), dtype=np.uint32)
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[at_a], last_b[at_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.append(0, at_b[:-1] + 1) if len(at_b) else NONE
    parts[np.arange(len(a)) + before_b[group_a]] = a | last_a * LAST
    parts[np.arange(len(b)) + at_a[group_b] + 1] = b | last_b * LAST | SIDE
    return parts


def packed(values: np.ndarray) -> bytes:
    """Numbers in 4 bytes each where they fit, else 8; the first byte is the width."""
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64) if data else NONE


# --- whole texts: one fragment, begun and ended by the text --------------------------------

WHOLE = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "links": pa.binary()}


def spaced(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """The units of texts that begin with the space B adds.

    A space at the very end begins none: B would read nothing after it and add no space.
    """
    starts, ends, first = spaced_runs(raw, offsets)
    kept = ends - starts > 1
    kept[first[:-1][np.diff(offsets) > 0]] = True
    starts = starts[kept]
    return starts, np.append(starts[1:], len(raw))[:len(starts)], np.searchsorted(starts, offsets)


def undivided(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """Every text as one unit, where a token of B may reach over a space."""
    some = np.diff(offsets) > 0
    return offsets[:-1][some], offsets[1:][some], np.append(0, np.cumsum(some))


def _whole_texts(p: Pair, table: UnitTable, raw: np.ndarray, offsets: np.ndarray) -> list[list]:
    """The columns of WHOLE for a few texts (each with the space before it), worked on together."""
    stream, sizes = unit_table.text_ids(table, raw, offsets, p.cuts)
    upto = np.append(0, np.cumsum(sizes))
    bad = np.flatnonzero(stream == BAD)
    if len(bad):
        good = np.ones(len(sizes), dtype=bool)
        good[np.searchsorted(upto, bad, side="right") - 1] = False
        stream, sizes = stream[np.repeat(good, sizes)], np.where(good, sizes, 0)
        upto = np.append(0, np.cumsum(sizes))
    of_b, last, ids = stream >= SIDE, (stream & LAST) > 0, (stream & ID).astype(np.int64)
    links = p.code(ids[last & ~of_b], ids[last & of_b])
    n_b, groups = (np.append(0, np.cumsum(x))[upto] for x in (of_b, last & of_b))
    body, width = p.text(stream)
    view, ends, groups = memoryview(body), np.append(0, np.cumsum(width))[upto].tolist(), groups.tolist()
    return [(sizes - np.diff(n_b)).tolist(), np.diff(n_b).tolist(), np.diff(groups).tolist(),
            [hashlib.sha256(view[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)],
            [packed(links[x:y]) if y > x else b"" for x, y in zip(groups, groups[1:], strict=False)]]


def pair_table(docs: DataFrame, path_a: str, path_b: str, text_col: str) -> UnitTable:
    """The marked ids of the frequent units of ``spaced_texts``."""
    return unit_table.build(docs, text_col, spaced if pair(path_a, path_b).cuttable else undivided,
                            lambda: pair(path_a, path_b).cuts)


def spaced_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with space + text; null where there is no text."""
    return docs.withColumn(text_col, F.when(F.octet_length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col))))


def align_whole(docs: DataFrame, path_a: str, path_b: str, text_col: str) -> DataFrame:
    """``docs`` without their texts, with the columns of WHOLE."""
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept, *[F.lit(0 if t == pa.int64() else "").cast(
        {pa.int64(): "long", pa.string(): "string"}.get(t, "binary")).alias(c) for c, t in WHOLE.items()]).schema
    docs = spaced_texts(docs, text_col)
    table = pair_table(docs, path_a, path_b, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(path_a, path_b)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
            columns: list[list] = [[] for _ in WHOLE]
            for lo, hi in chunks(offsets):
                found = _whole_texts(p, table, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for column, part in zip(columns, found, strict=True):
                    column.extend(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(v, t) for v, t in zip(columns, WHOLE.values(), strict=True)], names=[*kept, *WHOLE])

    return map_batches(docs, work, schema)


# --- long texts: a fragment per byte range --------------------------------------------------


def safe_places(full: bytes) -> np.ndarray:
    """Offsets of spaces that follow a character which is no white space, 0 and the end.

    A space at the very end is none: B would read nothing after it and add no space.
    """
    raw = np.frombuffer(full, dtype=np.uint8)
    at = np.flatnonzero(raw[:-1] == 0x20)
    at = at[at >= 3]
    one, two, three = raw[at - 1].astype(np.int64), raw[at - 2].astype(np.int64), raw[at - 3].astype(np.int64)
    blank = (one == 0x20) | ((one >= 0x09) & (one <= 0x0D)) | ((one >= 0x1C) & (one <= 0x1F))
    # white space beyond ASCII ends with these bytes (some of what is left out here is none)
    blank |= ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A))
    blank |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    return np.concatenate([[0], at[~blank], [len(full)]])


def ranges(full: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, from, to): byte ranges, and the safe places around them."""
    safe, out, begin = safe_places(full), [], 0
    while begin < len(full):
        end = min(begin + size, len(full))
        before = int(safe[np.searchsorted(safe, end, side="right") - 1])
        after = int(safe[np.searchsorted(safe, end)])
        if after - before > size // 4:
            end = after
        out.append((begin, end, int(safe[np.searchsorted(safe, begin, side="right") - 1]),
                    int(safe[np.searchsorted(safe, end)])))
        begin = end
    return out


PARTS = "key long, part int, parts int, begin long, end long, at long, slice string"


def cut_ranges(docs: DataFrame, key: str, text_col: str, size: int) -> DataFrame:
    """Rows of PARTS: every long text as byte ranges with the text around them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                full = (" " + text.as_py()).encode()
                found = ranges(full, size)
                for lo in range(0, len(found), 8):
                    rows = [(k.as_py(), lo + i, len(found), begin, end, start, full[start:stop].decode())
                            for i, (begin, end, start, stop) in enumerate(found[lo:lo + 8])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
                                                        [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.string()],
                                                        strict=True)],
                        names=["key", "part", "parts", "begin", "end", "at", "slice"])

    return map_batches(docs.select(F.col(key).alias("key"), text_col), work, PARTS)


FRAGMENTS = ("key long, part int, parts int, n_a long, n_b long, n_groups long, good boolean, body string, links binary, "
             "first int, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary")
_FRAGMENT_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.string(), pa.binary(), pa.int32(),
                   *[pa.binary()] * 4]
_FRAGMENT_NAMES = [c.split()[0] for c in FRAGMENTS.split(", ")]


def fragment_of(p: Pair, part: int, begin: int, end: int, at: int, piece: str):
    """(tokens of A and B, closed groups, body, links, Fragment) of one range; None if bytes differ."""
    found = p.both(piece[1:])
    if found is None:
        return None
    streams = []
    for ids, sizes in zip(found, (p.size_a, p.size_b), strict=True):
        ends = at + np.cumsum(sizes[ids])
        inside = (ends > begin) & (ends <= end)
        streams.append((ids[inside], ends[inside]))
    (a, ends_a), (b, ends_b) = streams
    at_a, at_b = aligned(a, ends_a, b, ends_b)
    if not len(at_a):
        return len(a), len(b), 0, "", NONE, Fragment((a, b), (NONE, NONE), -1)
    fa, fb, la, lb = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
    body, _ = p.text(marked(a[fa:la], b[fb:lb], at_a[1:] - fa, at_b[1:] - fb))
    return (len(a), len(b), len(at_a) - 1, body.tobytes().decode(), p.code(a[at_a[1:]], b[at_b[1:]]),
            Fragment((a[:fa], b[:fb]), (a[la:], b[lb:]), part))


def encode_ranges(parts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of FRAGMENTS, one per byte range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(path_a, path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                found = fragment_of(p, r["part"], r["begin"], r["end"], r["at"], r["slice"])
                n_a, n_b, groups, body, links, one = found or (0, 0, 0, "", NONE, Fragment())
                row = [r["key"], r["part"], r["parts"], n_a, n_b, groups, found is not None, body, packed(links), one.first,
                       *[packed(x) for x in (*one.prefix, *one.suffix)]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FRAGMENT_TYPES, strict=True)],
                                                 names=_FRAGMENT_NAMES)

    return map_batches(parts.repartition("key", "part"), work, FRAGMENTS)


OPEN = "key long, part int, first int, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary"
JOINTS = "key long, kind string, part int, first int, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary"


def compose_level(opened: DataFrame, last: bool) -> DataFrame:
    """Rows of JOINTS: kind ``f`` are the composed fragments, numbered anew, kind ``j`` the groups
    that composing closed (ids in ``prefix_*``, ``first``: the range whose body they precede).

    At the last level a document's one fragment begins and ends with the text: its prefix is a group.
    """
    names = [c.split()[0] for c in JOINTS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, one, out = None, Fragment(), []

        def close():
            key, group = current
            for first, a, b in one.joints:
                out.append((key, "j", group, first, packed(a), packed(b), b"", b""))
            if last:
                if one.first >= 0:
                    out.append((key, "j", group, one.first, packed(one.prefix[0]), packed(one.prefix[1]), b"", b""))
            else:
                out.append((key, "f", group, one.first, *[packed(x) for x in (*one.prefix, *one.suffix)]))

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["key"], r["part"] // FAN_IN)
                if now != current:
                    if current is not None:
                        close()
                    current, one = now, Fragment()
                one = compose(one, Fragment((unpacked(r["prefix_a"]), unpacked(r["prefix_b"])),
                                            (unpacked(r["suffix_a"]), unpacked(r["suffix_b"])), r["first"]))
            if out:
                yield flush()
                out = []
        if current is not None:
            close()
        if out:
            yield flush()

    ordered = opened.repartition("key", F.expr(f"part div {FAN_IN}")).sortWithinPartitions("key", "part")
    return map_batches(ordered, work, JOINTS)


def _digests(rows: DataFrame) -> DataFrame:
    """``key, groups_sha256`` from (key, place, kind, body) rows, streamed in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done, held = None, None, [], ""

        def flush():
            keys, values = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())],
                                              names=["key", "groups_sha256"])

        for batch in batches:
            bodies = batch.column(1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key != current:
                    if current is not None:
                        digest.update(held[:-1].encode())
                        done.append((current, digest.hexdigest()))
                    current, digest, held = key, hashlib.sha256(), ""
                body = bodies[i].as_py()
                if body:
                    # the last separator of a document is left out
                    digest.update(held.encode())
                    held = body
            if done:
                yield flush()
                done = []
        if current is not None:
            digest.update(held[:-1].encode())
            done.append((current, digest.hexdigest()))
            yield flush()

    ordered = rows.repartition("key").sortWithinPartitions("key", "place", "kind")
    return map_batches(ordered.select("key", "body"), work, "key long, groups_sha256 string")


def align_long(docs: DataFrame, key: str, path_a: str, path_b: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(per long text the columns of WHOLE but links, link rows (key, links)), through the tree."""
    spark = docs.sparkSession
    base = stored(encode_ranges(cut_ranges(docs, key, text_col, size), path_a, path_b), "fragments")
    most = base.agg(F.max("parts")).first()[0] or 0
    bad = base.where(~F.col("good")).select("key").distinct()
    level = base.join(bad, "key", "left_anti").select(*[c.split()[0] for c in OPEN.split(", ")])
    joints = None
    while most > 0:
        most = -(-most // FAN_IN) if most > 1 else 0
        done = stored(compose_level(level, last=most <= 1), "compose")
        closed = done.where("kind = 'j'")
        joints = closed if joints is None else joints.unionByName(closed)
        if most <= 1:
            break
        level = done.where("kind = 'f'").drop("kind")
    if joints is None:
        joints = spark.createDataFrame([], JOINTS)

    def name_joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(path_a, path_b)
        for batch in batches:
            bodies, links = [], []
            for r in batch.to_pylist():
                a, b = unpacked(r["prefix_a"]), unpacked(r["prefix_b"])
                bodies.append(",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())) + ";")
                links.append(packed(p.code(a[-1:], b[-1:])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(bodies, pa.string()), pa.array(links, pa.binary())],
                names=["key", "place", "body", "links"])

    named = stored(map_batches(joints, name_joints, "key long, place int, body string, links binary"), "joints")
    sound = base.join(bad, "key", "left_anti")
    text = named.select("key", "place", F.lit(0).alias("kind"), "body").unionByName(
        sound.select("key", F.col("part").alias("place"), F.lit(1).alias("kind"), "body"))
    links = named.select("key", "links").unionByName(sound.select("key", "links"))
    groups = named.groupBy("key").agg(F.count(F.lit(1)).alias("joined"))
    rows = sound.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")]) \
        .join(groups, "key", "left").join(_digests(text), "key") \
        .select("key", "n_a", "n_b", (F.col("n_groups") + F.coalesce("joined", F.lit(0))).alias("n_groups"), "groups_sha256")
    return rows, links


# --- corpus counts ----------------------------------------------------------------------------


def pair_counts(links: DataFrame) -> DataFrame:
    """``code, n`` of all linked pairs; summed in every task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = NONE, NONE

        def merged(parts):
            nonlocal codes, counts
            every = np.concatenate([codes, *parts])
            n = np.concatenate([counts, np.ones(len(every) - len(codes), dtype=np.int64)])
            codes, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weights=n, minlength=len(codes)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        for batch in batches:
            parts, size = [], 0
            for data in batch.column(0):
                if data.is_valid:
                    parts.append(unpacked(data.as_buffer()))
                    size += len(parts[-1])
                if size > HELD:
                    merged(parts)
                    parts, size = [], 0
            merged(parts)
            if len(codes) > HELD:
                yield rows()
                codes, counts = NONE, NONE
        yield rows()

    return map_batches(links.select("links"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """Sorted arrays of pair codes, their counts and whether they are their B id's highest."""

    folder: str
    shards: int


def write_counts(counts: DataFrame, size_b: int) -> Counts:
    spark = counts.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_folder(spark, "pair-counts")
    counts = stored(counts, "pairs").withColumn("b", F.pmod("code", F.lit(size_b)))
    # at most one row per id of B
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    rows = counts.join(highest, "b").select(F.pmod("code", F.lit(shards)).cast("int").alias("shard"), "code", "n",
                                            (F.col("n") == F.col("most")).alias("best"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close():
            for name, i, kind in (("k", 1, "<i8"), ("n", 2, "<i8"), ("m", 3, "u1")):
                _save(folder, f"{name}-{current}", np.concatenate([h[i] for h in held]).astype(kind))

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for s in np.unique(columns[0]).tolist():
                if s != current:
                    if held:
                        close()
                    current, held = s, []
                of = columns[0] == s
                held.append([c[of] for c in columns])
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    map_batches(rows.repartition(shards, "shard").sortWithinPartitions("shard", "code"), work, "done long").agg(
        F.sum("done")).collect()
    return Counts(folder, shards)


@lru_cache(maxsize=8192)
def _array(folder: str, name: str, kind: str) -> np.ndarray:
    return _map(folder, name, kind)


def look_up(counts: Counts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, is its B id's highest) of pair codes, all of which are there."""
    n, best = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
    unique, back = np.unique(codes, return_inverse=True)
    un, ub = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=bool)
    shard = unique % counts.shards
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(counts.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        of = order[cuts[s]:cuts[s + 1]]
        at = np.searchsorted(_array(counts.folder, f"k-{s}", "<i8"), unique[of])
        un[of] = _array(counts.folder, f"n-{s}", "<i8")[at]
        ub[of] = _array(counts.folder, f"m-{s}", "u1")[at] != 0
    n[:], best[:] = un[back], ub[back]
    return n, best


def link_scores(frame: DataFrame, counts: Counts) -> DataFrame:
    """``frame`` with ``n_links, n_best, count_sum`` in place of its column ``links``."""
    kept = [c for c in frame.columns if c != "links"]
    schema = frame.select(*kept, *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("links"))
            found = [unpacked(d.as_buffer()) if d.is_valid else NONE for d in column]
            sizes, totals = np.array([len(f) for f in found], dtype=np.int64), np.zeros((2, len(found)), dtype=np.int64)
            lo = 0
            while lo < len(found):
                hi = lo + max(int(np.searchsorted(np.cumsum(sizes[lo:]), HELD, side="right")), 1)
                n, best = look_up(counts, np.concatenate(found[lo:hi]))
                starts = np.append(0, np.cumsum(sizes[lo:hi]))
                for row, values in ((0, best.astype(np.int64)), (1, n)):
                    upto = np.append(0, np.cumsum(values))
                    totals[row, lo:hi] = upto[starts[1:]] - upto[starts[:-1]]
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(sizes), pa.array(totals[0]), pa.array(totals[1])],
                names=[*kept, "n_links", "n_best", "count_sum"])

    return map_batches(frame, work, schema)


RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", size: int = RANGE) -> DataFrame:
    """``docs`` without the text column, with the columns of RESULT; one row per row."""
    docs = docs.drop(*[c for c in docs.columns if c != text_col and c.lower() in (*RESULT, "links")])
    kept = [c for c in docs.columns if c != text_col]
    is_long = F.coalesce(F.octet_length(text_col), F.lit(0)) > 2 * size
    key = free_name(docs, "key")
    short = stored(align_whole(docs.where(~is_long), path_a, path_b, text_col), "aligned")
    # long texts get a number that is written down before it is used
    long = stored(docs.where(is_long).withColumn(key, F.monotonically_increasing_id()), "long-texts")
    rows, links = align_long(long, key, path_a, path_b, text_col, size)
    links = stored(links, "long-links")
    counts = write_counts(pair_counts(short.select("links").unionByName(links.select("links"))),
                          len(pair(path_a, path_b).bytes_b))
    scored = link_scores(links, counts).groupBy(F.col("key").alias(key)).agg(
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    found = long.drop(text_col).join(rows.withColumnRenamed("key", key), key, "left").join(scored, key, "left")
    zero = {"groups_sha256": F.lit("")}
    return link_scores(short, counts).select(*kept, *RESULT).unionByName(found.select(
        *kept, *[F.coalesce(F.col(c), zero.get(c, F.lit(0))).alias(c) for c in RESULT]))
