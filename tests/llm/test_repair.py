"""Conversation repair against a plain enumeration over the role pattern, and its defined cases."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from calibra.llm import repair
from calibra.llm.queries import damaged

EMPTY = hashlib.sha256(b"").hexdigest()
ROLE = {"s": "system", "u": "user", "a": "assistant"}
PATTERN = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """All edit strings up to two insertions per gap; rows: (role, text, kind)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    edits = []
    for role, text, kind in rows:
        own = [("D", 4, None)]
        if kind != repair.GONE:
            extra = 3 if kind == repair.CUT else 0
            own += [("K", extra, (role, text))] if role[:1] in ROLE else []
            own += [("R", 3 + extra, (ROLE[t], text)) for t in "ua"]
        edits.append(own)
    for choice in itertools.product(*edits):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            turns = [(ROLE[t], "") for t in inserted[0]]
            audit, cost = "I" * len(inserted[0]), 3 * sum(map(len, inserted))
            for (letter, c, turn), gap in zip(choice, inserted[1:], strict=True):
                audit, cost = audit + letter + "I" * len(gap), cost + c
                turns += ([turn] if turn else []) + [(ROLE[t], "") for t in gap]
            if PATTERN.match("".join(r[:1] for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return best


def judge(rows):
    """Sorted rows (turn, role, text) with their kinds, by the rules' wording."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = (repair.GONE if not solid or (role, text) in seen
                else repair.SOUND if solid[-1] in ".!?" else repair.CUT)
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def test_automaton_reads_the_pattern():
    lr = repair.Automaton()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            top = 0
            for t in word:
                top = None if top is None else lr.shift(top, t)
            assert (top is not None and lr.accepts(top)) == bool(PATTERN.match("".join(word))), word


def test_equals_enumeration():
    rng, repairer = random.Random(3), repair.Repairer()
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice([0, 0, 1, 2]))
                for i in range(rng.randint(0, 3))]
        state = repair.Conversation(repairer)
        for row in rows:
            state.feed(*row)
        assert state.result() == cheapest(rows), rows


def test_long_conversation_keeps_every_letter():
    rng, repairer = random.Random(4), repair.Repairer()
    state = repair.Conversation(repairer)
    for i in range(5000):
        state.feed(rng.choice(["user", "assistant"]), f"t{i}", rng.choice([0, 1, 2]))
    cost, audit, _ = state.result()
    assert len(audit.replace("I", "")) == 5000 and cost > 0


def test_table_against_enumeration(spark):
    rng, texts = random.Random(5), ["Yes.", "no", "", " \t", "Why?", "Yes."]
    data = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["system", "user", "assistant", None]), rng.choice([*texts, None]))
            for c in [*range(40), None] for _ in range(rng.randint(1, 3))]
    frame = spark.createDataFrame(data, SCHEMA).withColumn("here", F.lit("clash")).withColumn("audit", F.lit(1))
    found = {r.conv_id: r for r in repair.repair_conversations(frame.repartition(3)).collect()}
    assert set(found) == {d[0] for d in data}
    for conv, r in found.items():
        own = [(t, x if x is not None else " ", y if y is not None else " ") for c, t, x, y in data if c == conv]
        turns = {t for t, _, _ in own if t is not None}
        kinds = judge(own)
        assert (r.cost, r.audit, r.repaired_sha256) == cheapest(kinds), own
        assert r.n_rows == len(own)
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        blank = sum(not re.sub(r"[\x20\x09-\x0D]", "", t) for _, t, _ in kinds)
        assert r.blank == blank and r.duplicate == sum(k == repair.GONE for *_, k in kinds) - blank
        assert r.truncated == sum(k == repair.CUT for *_, k in kinds)
        initials = [role[:1] for role, _, _ in kinds]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))

    turns = repair.repaired_turns(frame, spark.createDataFrame(
        [(r.conv_id, r.audit) for r in found.values()], "conv_id long, audit string")).collect()
    for conv, r in found.items():
        own = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.turn)
        assert [t.turn for t in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert "".join(t.edit for t in own) == r.audit.replace("D", "")


def test_absent_rows_name_their_conversation(spark):
    frame = spark.createDataFrame([(7, 0, "user", "x."), (8, 0, "user", "y."), (8, 1, "assistant", "z.")], SCHEMA)
    found = {r.conv_id: r for r in repair.repair_conversations(frame, F.col("conv_id") == 8).collect()}
    assert (found[7].n_rows, found[7].cost, found[7].audit, found[7].repaired_sha256) == (0, 0, "", EMPTY)
    assert (found[8].cost, found[8].audit) == (0, "KK")


def test_empty_table(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("extra", [0, 1])
def test_very_long_text_and_repeats(spark, extra):
    text = "word " * 200_000 + "end" + "." * extra
    frame = spark.createDataFrame([(1, 0, "user", text)] * 3 + [(1, 1, "assistant", "ok.")], SCHEMA)
    r = repair.repair_conversations(frame).first()
    assert (r.duplicate, r.truncated, r.audit, r.cost) == (2, 1 - extra, "KDDK", 8 + 3 * (1 - extra))


def test_damage_covers_every_fate(spark):
    import zlib

    rows = [(c, t, None if c % 7 == 0 else "assistant", "a. b! c?") for c in range(40) for t in (0, None)]
    out = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        own = [r for r in out if (r.conv_id, r.turn) == (c, t)]
        assert len(own) == (2 if fate == 3 else 1) and all(r.here == (fate != 0) for r in own)
        assert own[0].role == ("user" if fate == 4 else role or " ")
        assert own[0].text == {1: "", 2: "a b c"}.get(fate, text)
