"""Conversation structure repair (operator 13): generalised LR repair of turn roles.

A repaired conversation's role initials follow the grammar

    conversation = (nothing) | dialog | system dialog
    dialog       = pair | dialog pair
    pair         = user assistant

Its LR automaton is built from these productions.  A conversation's rows are the
input; every row may be kept (K, 0), reroled to user or assistant (R, 3) or deleted
(D, 4), and an empty turn of either role may be inserted anywhere (I, 3).  Blank
and repeated rows must be deleted; a truncated row that stays adds 3.  All actions
that the automaton allows are followed at once on a graph-structured stack: tops
that share the nodes below them, where equal tops merge and the minimum of (cost,
audit) survives.  The audit is the edits' letters in order, so of equally cheap
repairs the one that sorts first wins; two audits of equal cost and equal rows are
never a proper prefix of one another, which makes the merge exact.

A top that costs more than the cheapest one plus ``SLACK`` is dropped: from any top
one insertion (3) reaches the other phase of a pair, and the only thing a dropped
top may still do that others can't, keeping a system turn, costs them a deletion (4).
What remains (tops, relative costs, order of their audits) takes few forms, so each
(form, kind of row) is worked out once and remembered.

Rows of one conversation are streamed in order through one task, because the
digest of its repaired text is sequential; per top only a running digest and the
audit (one byte a row) are held, never the texts.  Repeated rows are found before
that, by a window over (conversation, role, text digest).

Defined results: a null role or text counts as one space; rows are ordered by turn
(nulls first), then role and text, and a repeated row directly follows its first; rows
with a null conv_id form one conversation; an empty role has no initial and is never
kept; a conversation without rows gives zeros, an empty audit and the digest of
the empty text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.llm.text import map_batches

TERMINALS = {"s": "system", "u": "user", "a": "assistant"}
PRODUCTIONS = [("conversation", ("s", "dialog")), ("conversation", ("dialog",)), ("dialog", ("dialog", "pair")),
               ("dialog", ("pair",)), ("pair", ("u", "a"))]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SLACK = INSERT + DELETE
#: kinds of rows: no fault, must go (blank or repeated), cut off
SOUND, GONE, CUT = 0, 1, 2
#: audits grow in pieces of so many letters
PIECE = 256


class Automaton:
    """LR(0) item sets of the grammar; stacks are interned nodes (state, node below)."""

    def __init__(self):
        rules = {}
        for left, right in PRODUCTIONS:
            rules.setdefault(left, []).append(right)

        def closed(items):
            items = set(items)
            while True:
                more = {(after, right, 0) for _, rhs, dot in items if dot < len(rhs)
                        for after in [rhs[dot]] for right in rules.get(after, [])} - items
                if not more:
                    return frozenset(items)
                items |= more

        start = closed(("conversation", right, 0) for right in rules["conversation"])
        self.states, self.goto, todo = [start], {}, [start]
        while todo:
            state = todo.pop()
            for symbol in {rhs[dot] for _, rhs, dot in state if dot < len(rhs)}:
                after = closed((left, rhs, dot + 1) for left, rhs, dot in state if dot < len(rhs) and rhs[dot] == symbol)
                if after not in self.states:
                    self.states.append(after)
                    todo.append(after)
                self.goto[self.states.index(state), symbol] = self.states.index(after)
        #: what a state's complete item reduces to; the whole conversation is reduced at the end only
        self.reduces = {i: (left, len(rhs)) for i, state in enumerate(self.states)
                        for left, rhs, dot in state if dot == len(rhs) and left != "conversation"}
        self.final = {i for i, state in enumerate(self.states)
                      if any(left == "conversation" and dot == len(rhs) for left, rhs, dot in state)}
        self.nodes, self.index, self.shifts = [(0, -1)], {(0, -1): 0}, {}

    def push(self, state: int, below: int) -> int:
        node = (state, below)
        if node not in self.index:
            self.index[node] = len(self.nodes)
            self.nodes.append(node)
        return self.index[node]

    def shift(self, top: int, terminal: str) -> int | None:
        """The top after reading a terminal and all reductions it completes; None if it can't be read."""
        if (top, terminal) not in self.shifts:
            state = self.goto.get((self.nodes[top][0], terminal))
            found = None if state is None else self.push(state, top)
            while found is not None and self.nodes[found][0] in self.reduces:
                left, size = self.reduces[self.nodes[found][0]]
                for _ in range(size):
                    found = self.nodes[found][1]
                found = self.push(self.goto[self.nodes[found][0], left], found)
            self.shifts[top, terminal] = found
        return self.shifts[top, terminal]

    def accepts(self, top: int) -> bool:
        return top == 0 or self.nodes[top][0] in self.final


class Repairer:
    """Forms of the frontier: per top its cost above the cheapest and its audit's place.

    A place is (rank, tail): audits of equal rank share a beginning and differ by
    their tails, audits of different rank compare by rank.  A move says which top
    of the form before it came from and by which edits: pairs (letter, terminal).
    """

    def __init__(self):
        self.lr = Automaton()
        self.steps: dict = {}
        self.start = self._settle({0: (0, (0, ""), 0, ())})

    def _settle(self, best: dict) -> tuple:
        """Insertions from every top, then the new form: (form, cheapest cost, moves)."""
        todo = list(best)
        while todo:
            top = todo.pop()
            cost, (rank, tail), source, edits = best[top]
            for terminal in "ua":
                after = self.lr.shift(top, terminal)
                if after is not None:
                    one = (cost + INSERT, (rank, tail + "I"), source, (*edits, ("I", terminal)))
                    if after not in best or one[:2] < best[after][:2]:
                        best[after] = one
                        todo.append(after)
        least = min(one[0] for one in best.values())
        kept = sorted((top, one) for top, one in best.items() if one[0] <= least + SLACK)
        places, rank, base = {}, -1, None
        for place in sorted({one[1] for _, one in kept}):
            if base is None or base[0] != place[0] or not place[1].startswith(base[1]):
                rank, base = rank + 1, place
            places[place] = (rank, place[1][len(base[1]):])
        form = tuple((top, one[0] - least, places[one[1]]) for top, one in kept)
        return form, least, tuple((one[2], one[3]) for _, one in kept)

    def step(self, form: tuple, initial: str, kind: int) -> tuple:
        """The form after a row whose role begins with ``initial``."""
        key = form, initial, kind
        if key not in self.steps:
            best: dict = {}

            def offer(top, cost, rank, tail, source, letter, terminal):
                one = (cost, (rank, tail + letter), source, ((letter, terminal),))
                if top is not None and (top not in best or one[:2] < best[top][:2]):
                    best[top] = one

            for source, (top, cost, (rank, tail)) in enumerate(form):
                offer(top, cost + DELETE, rank, tail, source, "D", None)
                if kind == GONE:
                    continue
                extra = TRUNCATED if kind == CUT else 0
                if initial in TERMINALS:
                    offer(self.lr.shift(top, initial), cost + KEEP + extra, rank, tail, source, "K", None)
                for terminal in "ua":
                    offer(self.lr.shift(top, terminal), cost + REROLE + extra, rank, tail, source, "R", terminal)
            self.steps[key] = self._settle(best)
        return self.steps[key]

    def best_end(self, form: tuple) -> int:
        return min((cost, place, i) for i, (top, cost, place) in enumerate(form) if self.lr.accepts(top))[2]


class Conversation:
    """One conversation's repairs in progress, fed with its rows in order."""

    def __init__(self, repairer: Repairer):
        self.repairer, self.cost = repairer, 0
        self.live: list = [(None, "", hashlib.sha256(), True)]
        self._move(repairer.start, "", "")

    def _move(self, settled: tuple, role: str, text: str) -> None:
        self.form, least, moves = settled
        self.cost += least
        body = f"{role}:{text}".encode() if any(e[0] == "K" for _, edits in moves for e in edits) else b""
        other = text.encode() if any(e[0] == "R" for _, edits in moves for e in edits) else b""
        live = []
        for source, edits in moves:
            past, letters, digest, empty = self.live[source]
            copied = False
            for letter, terminal in edits:
                letters += letter
                if letter == "D":
                    continue
                if not copied:
                    digest, copied = digest.copy(), True
                if not empty:
                    digest.update(b"\n")
                empty = False
                if letter == "K":
                    digest.update(body)
                else:
                    digest.update(f"{TERMINALS[terminal]}:".encode())
                    if letter == "R":
                        digest.update(other)
            if len(letters) >= PIECE:
                past, letters = (past, letters), ""
            live.append((past, letters, digest, empty))
        self.live = live

    def feed(self, role: str, text: str, kind: int) -> None:
        self._move(self.repairer.step(self.form, role[:1], kind), role, text)

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired turns)."""
        end = self.repairer.best_end(self.form)
        past, letters, digest, _ = self.live[end]
        parts = [letters]
        while past is not None:
            past, letters = past
            parts.append(letters)
        return self.cost + self.form[end][1], "".join(reversed(parts)), digest.hexdigest()


WHITE = " \t\n\x0b\f\r"


def judged_rows(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, here, blank, again, cut`` of every row, one shuffle.

    ``here`` is false where ``present`` is: such a row only names its conversation.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    space = F.lit(" ")
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), space).alias("role"),
                         F.coalesce(F.col("text").cast("string"), space).alias("text"), here.alias("here"))
    # rows that are not there need neither text nor place
    source = source.select("conv_id", "here", *[F.when(F.col("here"), F.col(c)).alias(c) for c in ("turn", "role", "text")])
    bare = F.rtrim("text", F.lit(WHITE))
    same = Window.partitionBy("conv_id", "here", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    return source.select(
        "*", (bare == "").alias("blank"), (F.row_number().over(same) > 1).alias("again"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("here").asc(), F.col("turn").asc_nulls_first(), "role", "text", "again")


def repair_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: ``conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256`` (digest of the repaired ``role:text`` lines)."""
    judged = judged_rows(rows, present)
    kind = judged.schema["conv_id"].dataType.simpleString()
    counts = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        current, state, done, id_type, size = None, None, [], None, 0

        def flush():
            types = [id_type, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for b in batches:
            id_type = b.column("conv_id").type
            ids = b.column("conv_id").to_pylist()
            columns = [b.column(c).to_pylist() for c in ("turn", "role", "here", "blank", "again", "cut")]
            for i, (turn, role, here, blank, again, cut) in enumerate(zip(*columns, strict=True)):
                if current is None or ids[i] != current[0]:
                    if current is not None:
                        done.append(state.row(current[0]))
                        size += len(done[-1][-2])
                        if len(done) >= 1000 or size > 1 << 20:
                            yield flush()
                            done, size = [], 0
                    current, state = (ids[i],), _Tally(repairer)
                if here:
                    state.feed(turn, role, b.column("text")[i].as_py(), blank, again, cut)
        if current is not None:
            done.append(state.row(current[0]))
        if done:
            yield flush()

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return map_batches(_ordered(judged), work, schema)


class _Tally(Conversation):
    """A conversation's counts of faults beside its repair."""

    def __init__(self, repairer: Repairer):
        super().__init__(repairer)
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def feed(self, turn, role, text, blank, again, cut) -> None:
        self.n += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not blank and not again
        super().feed(role, text, GONE if blank or again else CUT if cut else SOUND)

    def row(self, conv_id) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (conv_id, self.n, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.result())


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, turn`` (from 0), ``role, text, edit``.

    ``repairs`` is the result of ``repair_conversations`` on the same rows.  Inserted
    turns have an empty text; deleted rows are absent.
    """
    judged = judged_rows(rows)
    kind = judged.schema["conv_id"].dataType.simpleString()
    audit = repairs.select(F.col("conv_id").alias("_id"), "audit")
    # the audit travels once per conversation, as the row before all others
    plan = audit.select(F.col("_id").alias("conv_id"), F.lit(False).alias("here"), F.lit(None).cast("long").alias("turn"),
                        F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("again"))
    both = judged.select("conv_id", "here", "turn", "role", "text", "again").unionByName(plan)
    names = ["conv_id", "turn", "role", "text", "edit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, place, state, automaton = "", 0, 0, 0, Automaton()
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            out: list[tuple] = []

            def put(conv, role, text, edit):
                nonlocal place, state
                out.append((conv, place, role, text, edit))
                place, state = place + 1, automaton.shift(state, role[:1])

            def insert(conv):
                nonlocal at
                while at < len(letters) and letters[at] == "I":
                    put(conv, _legal(automaton, state), "", "I")
                    at += 1

            for i, (role, here) in enumerate(zip(b.column("role").to_pylist(), b.column("here").to_pylist(), strict=True)):
                text = b.column("text")[i].as_py()
                if not here:
                    letters, at, place, state = text, 0, 0, 0
                    insert(ids[i])
                    continue
                edit = letters[at]
                at += 1
                if edit == "K":
                    put(ids[i], role, text, "K")
                elif edit == "R":
                    put(ids[i], _legal(automaton, state), text, "R")
                insert(ids[i])
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [b.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return map_batches(_ordered(both), work, f"conv_id {kind}, turn long, role string, text string, edit string")


def _legal(automaton: Automaton, top: int) -> str:
    """The one role of user and assistant that may follow."""
    return next(TERMINALS[t] for t in "ua" if automaton.shift(top, t) is not None)
