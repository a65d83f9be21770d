"""Chat formatting (operator 4): a template with a grammar round trip.

Every turn becomes one segment ``begin-marker text end-marker``; a
conversation's formatted text is its segments in turn order.  The grammar:

    conversation = turn*
    turn         = "<<SYS>>" text "<</SYS>>"          (system)
                 | "[INST]" text "[/INST]"            (user)
                 | "<s>" text "</s>"                  (assistant)
                 | "<<ROLE>>" role "<<TEXT>>" text "<</ROLE>>"   (any other role)

Control strings inside texts are escaped with backslashes: a run of ``m``
backslashes directly before a control string is content when ``m`` is odd
((m-1)/2 backslashes and the literal string) and a real marker after m/2
backslashes when ``m`` is even.  A rendered turn is parsed again at once; only
if the parse differs from the source is the escaped form used, which is then
parsed and compared too (the round trip always ends in an identical turn or an
error, never in changed data).

Rendering is row-wise and needs no shuffle.  Reading back streams the segments
of a conversation in order, so a conversation of any length needs bounded
memory: only a running digest is kept, never the list of turns.

Defined results: a null text counts as empty, a null role as the empty role;
null turns come first; rows with equal turn are ordered by role and text;
repeated rows are separate turns; rows with a null conv_id form one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: markers of the template
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<<ROLE>>", "<<TEXT>>", "<</ROLE>>"
CONTROLS = sorted({m for pair in MARKERS.values() for m in pair} | {ROLE, TEXT, END}, key=len, reverse=True)
TOKEN = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
BEFORE_MARKER = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + r"|\Z)")
BEGINS = {begin: (role, end) for role, (begin, end) in MARKERS.items()}


def escape(text: str) -> str:
    """Double the backslashes before control strings and the text's end; one more marks content."""
    return BEFORE_MARKER.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def read_text(segment: str, at: int) -> tuple[str, str, int, int]:
    """Text from ``at`` up to the next real marker: (text, marker, where the marker is, its end)."""
    parts, last = [], at
    for m in TOKEN.finditer(segment, at):
        slashes = len(m[1])
        parts += [segment[last:m.start()], "\\" * (slashes // 2)]
        if slashes % 2 == 0:
            return "".join(parts), m[2], m.start(2), m.end()
        parts.append(m[2])
        last = m.end()
    raise ValueError("no end marker")


def parse_turn(segment: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """One turn at ``at``: (role, text, start and end of its rendered text, where the turn ends)."""
    begin = next((c for c in (*BEGINS, ROLE) if segment.startswith(c, at)), None)
    if begin is None:
        raise ValueError("no turn begins here")
    start = at + len(begin)
    if begin == ROLE:
        role, marker, _, start = read_text(segment, start)
        if marker != TEXT or role in MARKERS:
            raise ValueError("malformed role")
        end = END
    else:
        role, end = BEGINS[begin]
    text, marker, stop, after = read_text(segment, start)
    if marker != end:
        raise ValueError("wrong end marker")
    return role, text, start, stop, after


def render_turn(role: str, text: str) -> str:
    """The turn's segment; escaped only where the plain form does not read back as itself."""
    for form in (str, escape):
        if role in MARKERS:
            begin, end = MARKERS[role]
            segment = begin + form(text) + end
        else:
            segment = ROLE + form(role) + TEXT + form(text) + END
        try:
            found = parse_turn(segment)
        except ValueError:
            continue
        if found[:2] == (role, text) and found[4] == len(segment):
            return segment
    raise ValueError("a turn cannot be rendered reversibly")


def format_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, seq_role, seq_text, segment, mask_start, mask_end`` per row.

    The mask is the span of the segment that the loss covers (assistant text,
    in code points); both ends are null for other roles.  ``seq_*`` only order
    rows of equal turn.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {"segment": [], "mask_start": [], "mask_end": []}
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                segment = render_turn(role or "", text or "")
                loss = role == "assistant"
                _, _, start, stop, _ = parse_turn(segment)
                out["segment"].append(segment)
                out["mask_start"].append(start if loss else None)
                out["mask_end"].append(stop if loss else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text_key"),
                 pa.array(out["segment"], pa.string()), pa.array(out["mask_start"], pa.int64()),
                 pa.array(out["mask_end"], pa.int64())],
                names=["conv_id", "turn", "seq_role", "seq_text", "segment", "mask_start", "mask_end"])

    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.col("text").cast("string").alias("text"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_key"))
    kind = source.schema["conv_id"].dataType.simpleString()
    return source.mapInArrow(
        render, f"conv_id {kind}, turn long, seq_role string, seq_text string, segment string, "
                "mask_start long, mask_end long")


class _Reader:
    """Running digests of one conversation, fed with its segments in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all_turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, mask_start, mask_end) -> None:
        at = 0
        while at < len(segment):
            role, text, start, stop, at = parse_turn(segment, at)
            self.turns += 1
            self.all_turns.update(f"{role}\n{text}\n".encode())
            if (start, stop) == (mask_start, mask_end):
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all_turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted segments and their masks."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, id_type = None, [], None

        def flush():
            columns = list(zip(*done, strict=True))
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, *segment in zip(*(b.column(c).to_pylist() for c in
                                        ("conv_id", "segment", "mask_start", "mask_end")), strict=True):
                if current is None or conv != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Reader(conv)
                current.feed(*segment)
            if len(done) >= 1000:
                yield flush()
                done = []
        if current is not None:
            done.append(current.row())
        if done:
            yield flush()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq_role", "seq_text", "segment")
    return ordered.select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Format all conversations and read the result back: one row per conversation."""
    return read_back(format_turns(rows))
