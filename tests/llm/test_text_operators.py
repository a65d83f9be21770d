"""Operators 1, 2, 4, 5, 7 and 10 on small fixtures: brute force, round trips, odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from calibra.llm import bpe, chat, langid, ngram_lm, pii, rollup
from calibra.llm.text import BATCH_BYTES, map_batches
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, score string, ids string, pii string"


def docs_of(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else None, "s", "i", "p") for i, t in enumerate(texts)], DOCS)


# --- 1: n-gram model ------------------------------------------------------------------


def kneser_ney(texts, order):
    """p(word | history) by dictionaries, straight from the formulas."""
    tokens = lambda t: ["<s>"] * (order - 1) + (t or "").encode().lower().split() + ["</s>"]
    grams = {order: Counter()}
    for t in texts:
        w = tokens(t)
        grams[order].update(tuple(w[i - order + 1:i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    disc = {k: ngram_lm.discounts(*(sum(c == i for c in g.values()) for i in (1, 2, 3, 4))) for k, g in grams.items()}
    ctx = {k: defaultdict(Counter) for k in grams}
    for k, g in grams.items():
        for gram, c in g.items():
            ctx[k][gram[:-1]].update({"total": c, min(c, 3): 1})
    vocabulary = {t for x in texts for t in tokens(x) if t != "<s>"}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(vocabulary) + 1)
        x = ctx[k].get(gram[:-1])
        if x is None:
            return p(gram[1:])
        c = grams[k].get(gram, 0)
        d = (0, *disc[k])
        return (c - d[min(c, 3)] + sum(d[i] * x[i] for i in (1, 2, 3)) * p(gram[1:])) / x["total"]

    def score(t):
        w = tokens(t)
        return sum(math.log10(p(tuple(w[i - order + 1:i + 1]))) for i in range(order - 1, len(w)))

    return score, p, vocabulary


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_dictionary_model(spark, order):
    rng = random.Random(order)
    words = [f"w{i}" for i in range(30)] + ["É", "The", "the", "x" * 3000]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "  \n", "the  THE\tthe", texts[0], texts[0]]
    model = ngram_lm.train(docs_of(spark, texts).repartition(4), order=order)
    held = [*texts, "never seen words here", "w1 never w2"]
    score, p, vocabulary = kneser_ney(texts, order)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs_of(spark, held), model).collect()}
    for i, t in enumerate(held):
        assert got[i]["score"] == pytest.approx(score(t), rel=1e-9), t
        assert got[i]["n_tokens"] == len((t or "").split()) + 1
    history = (b"w1",) * (order - 1)
    assert sum(p((*history, w)) for w in vocabulary) + p((*history, "?")) == pytest.approx(1.0)


def test_model_of_nothing(spark):
    model = ngram_lm.train(docs_of(spark, []))
    rows = ngram_lm.score(docs_of(spark, ["a b", None]), model).collect()
    assert [r["n_tokens"] for r in rows] == [3, 1] and all(r["n_known"] == 0 for r in rows)
    assert ngram_lm.score(docs_of(spark, []), model).count() == 0


# --- 2: languages ---------------------------------------------------------------------


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.train(docs.where(~held))
    found = langid.identify(docs.where(held), model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_odd_texts(spark):
    train = docs_of(spark, ["das ist ein wort und noch eins " * 5, "the words are here and there " * 5, None, "x"],
                    ["de", "en", "en", None])
    model = langid.train(train)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(
        docs_of(spark, [None, "", "123 !?", "日本", "the words are there", "Das ist noch ein Wort", "the " * 100_000]),
        model).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["und"] * 3
    assert (got[4], got[5], got[6]) == ("en", "de", "en") and got[3] in ("de", "en")
    nothing = langid.train(docs_of(spark, []))
    assert [r["lang_pred"] for r in langid.identify(docs_of(spark, ["abc"]), nothing).collect()] == ["und"]


def test_bitmasks_hold_more_than_64_languages():
    members = {f"l{i:03}": np.arange(50 * i, 50 * i + 50, dtype=np.uint32) for i in range(70)}
    f = langid.LanguageFilter.build(members)
    hits = f.hits(np.arange(3450, 3500, dtype=np.uint32), np.zeros(50, dtype=np.int32), 1)[0]
    assert hits[69] == 50 and np.delete(hits, 69).max() < 10


# --- 4: chat --------------------------------------------------------------------------


def test_hostile_turns_round_trip():
    rng = random.Random(4)
    bits = [*chat.CONTROLS, "\\", "\\\\", "a", "\n", "[", "<", "/", ">", "]", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        role = rng.choice(["user", "assistant", "system", "tool", "", "<s>\\", "<<TEXT>>"])
        segment = chat.render_turn(role, text)
        got = chat.parse_turn(segment + chat.render_turn("user", "x"))
        assert (got[0], got[1], got[4]) == (role, text, len(segment))


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be <s>"), (1, 2, "assistant", "\\[INST] yes"), (1, 1, "user", None), (2, 0, None, ""),
            (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "q" * 200_000), (3, None, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("system\nbe <s>\nuser\n\nassistant\n\\[INST] yes\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (11, sha("\\[INST] yes"))
    assert (got[2]["n_turns"], got[2]["turns_sha256"]) == (3, sha("\n\nuser\nx\nuser\nx\n"))
    assert got[None]["loss_chars"] == 200_000 and got[3]["n_turns"] == 1
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 5: rollups -----------------------------------------------------------------------


def test_rollup_commits_once_and_compacts(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, op string, tokens_before long, tokens_after long"
    store = rollup.RollupStore(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "t", "I", None, 5), ("a", "en", "t", "I", 0, 7), (None, None, "t", "I", 0, 1)], schema)
    second = spark.createDataFrame([("a", "en", "t", "D", 5, 0), ("a", "en", "t", "U", 7, 9)], schema)
    assert store.commit("1", first) and not store.commit("1", first)
    assert store.commit("2", second) and store.commit("3", first.limit(0))
    want = {("a", "en", "t", 1, 9), (None, None, "t", 1, 1)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("2", second)          # still known after compaction
    assert store.commit("4", spark.createDataFrame([("a", "en", "t", "D", 9, 0)], schema))
    assert ("a", "en", "t", 0, 0) in {tuple(r) for r in store.totals().collect()}
    store.compact()
    assert store.batches() == [] and not store.commit("4", second)
    with pytest.raises(Exception, match="op must be"):
        store.commit("5", spark.createDataFrame([("a", "en", "t", "X", 0, 0)], schema))


def test_rollup_takes_any_batch_id(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, op string, tokens_before long, tokens_after long"
    one = spark.createDataFrame([("a", "en", "t", "I", 0, 1)], schema)
    store = rollup.RollupStore(spark, str(tmp_path / "store"))
    ids = ["a+b", "base+x", "a/b=c:d", "é" * 400, *[f"2024-01-01T00:00:{i:02d}Z+x" for i in range(12)]]
    assert all(store.commit(i, one) for i in ids) and store.batches() == sorted(ids)
    store.compact()
    # parts of a folded id are ids of their own; folded ids are known
    assert store.commit("a", one) and store.commit("b", one) and not store.commit("a+b", one)
    assert store.totals().first().n_docs == len(ids) + 2
    store.compact()
    assert store.totals().first().n_docs == len(ids) + 2 and store.batches() == []
    assert len([p for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")]) == 1
    with pytest.raises(ValueError):
        store.commit("", one)


def test_chat_orders_tied_turns_by_role_and_text(spark):
    texts = ["b", "a", "a[/INST]", "aA", "", None, "~", "[INST]"]
    rows = [(c, 0, r, t) for c in range(3) for r in ("user", "assistant", None) for t in texts]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for r in chat.format_conversations(frame).collect():
        own = sorted(((role or "", t or "") for c, _, role, t in rows if c == r.conv_id))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()


def test_a_language_with_one_short_text_knows_it(spark):
    texts = ["The quick brown fox and the lazy dog by the river bank number %d." % i for i in range(50)]
    texts.append("Það er gott að vera hér við sjóinn í dag.")
    docs = docs_of(spark, texts, ["en"] * 50 + ["is"])
    found = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert found[50].lang_pred == "is" and found[50].score > 0.9
    assert all(found[i].lang_pred == "en" for i in range(50))


def test_a_column_of_countless_languages_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = docs_of(spark, ["some text"] * 5, list("abcde"))
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_counts_of_any_size_are_kept(tmp_path):
    for most in (0, 200, 300, 70_000, 5_000_000_000):
        counts = np.array([1, most, 2], dtype=np.int64)
        ngram_lm._save_counts(str(tmp_path), f"c-{most}", counts)
        assert ngram_lm._map_counts(str(tmp_path), f"c-{most}").tolist() == counts.tolist()


# --- 7: byte-level BPE ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_tiktoken(name):
    import tiktoken

    pairs = bpe.BytePairs(public_tokenizers.path(name), public_tokenizers.PATTERN)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = random.Random(7)
    bits = ["a", "b", "th", "e", " ", "  ", "\n", "'s", "é", "漢", "😀", "1", "23", "!!", "\t", " ", " ", "\x1c", "==", "ing"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["a" * 30_000, "ab" * 5_000 + " " * 3_000, "<|endoftext|>"]
    for t in texts:
        ids = np.frombuffer(pairs.encode(t), dtype=np.uint32).tolist()
        assert ids == exact.encode_ordinary(t)
        assert pairs.decode(ids) == t.encode()
        assert "".join(bpe.safe_cuts(t)) == t


def test_bpe_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["Hello wörld", None, "", " x" * 50_000]
    coded = bpe.encode(docs_of(spark, texts), path, public_tokenizers.PATTERN)
    back = bpe.decode(coded, path, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [t or "" for t in texts]
    assert bpe.encode(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


# --- 10: personal data ----------------------------------------------------------------

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def rule_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m[0])] for k, p in RULES.items()}


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    bits = ["a@b.co", "@", ".", "x.y", "1", "255", "256", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+", "+1 (22",
            ") 333-4444", "-", " ", "\n", "é", "00", "%", "a@b", "@c.d", "+49 30 1234567"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pii.base_spans(text) == rule_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "@" * 300_000, "a.b@" * 80_000):
        pii.base_spans(text)
        list(pii.candidates(text))


def test_trees_find_disguised_and_leave_clean(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for i in range(600):
        parts = [word() for _ in range(20)]
        kind = i % 4
        if kind == 0:
            parts.insert(9, f"{word()}@{word()}.com")
        elif kind == 1:
            parts.insert(9, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}")
        elif kind == 2:
            parts.insert(9, f"{rng.randint(1, 99)}.{rng.randint(100, 999999)}.{rng.randint(1, 9)}")
        texts.append(" ".join(parts))
    judge = pii.train(docs_of(spark, texts))
    clean = " ".join(word() for _ in range(30))
    probe = [f"{clean} jane (at) mail.com {clean}", clean, None, "", texts[1], texts[2]]
    got = {r["doc_id"]: r for r in pii.find(docs_of(spark, probe), judge).collect()}
    assert [s["kind"] for s in got[0]["pii"]] == ["email"] and "jane" not in got[0]["redacted"]
    assert [len(got[i]["pii"]) for i in (1, 2, 3, 5)] == [0, 0, 0, 0] and got[2]["redacted"] is None
    assert "[PHONE]" in got[4]["redacted"] and [s["base"] for s in got[4]["pii"]] == [True]
    row = pii.find(docs_of(spark, probe), judge).select("doc_id", *pii.digest_columns()).where("doc_id = 4").first()
    assert row["base_sha256"] == pii.fingerprint(pii.base_spans(texts[1])) and row["n_phone"] == 1


def test_pii_without_anything_to_learn(spark):
    judge = pii.train(docs_of(spark, ["no numbers here", None]))
    assert pii.find(docs_of(spark, []), judge).count() == 0
    assert pii.find(docs_of(spark, ["a@b.co"]), judge).first()["redacted"] == "[EMAIL]"


def test_batches_are_bounded_by_bytes_and_keep_every_row(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("0123456789"), 10_000).alias("text"))
    found = map_batches(texts, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 300
    assert len(found) > 1 and max(r["size"] for r in found) < 2 * BATCH_BYTES
    longer = spark.range(1).select(F.repeat(F.lit("0123456789"), BATCH_BYTES // 5).alias("text"))
    assert [r["n"] for r in map_batches(longer, sizes, "n long, size long").collect()] == [1]


def test_pii_proposes_every_number_of_a_list():
    numbers = [f"555-123-{4567 + i}" for i in range(40)]
    text = ", ".join(numbers)
    assert set(numbers) <= {text[s:e] for k, s, e in pii.candidates(text) if k == "phone"}
    text = "5551234567,5551234568/4111111111111111.4012888888881881"
    found = {(k, text[s:e]) for k, s, e in pii.candidates(text)}
    assert {("phone", "5551234567"), ("phone", "5551234568"), ("card", "4111111111111111"), ("card", "4012888888881881")} <= found
    text = "call (555) 123-4567, (555) 123-4568"
    assert {"(555) 123-4567", "(555) 123-4568"} <= {text[s:e] for _, s, e in pii.candidates(text)}


def test_language_of_texts_shorter_than_an_ngram(spark):
    model = langid.LanguageFilter.build({"en": np.array([1], dtype=np.uint32), "es": np.array([2], dtype=np.uint32)})
    docs = spark.createDataFrame([(1, "I"), (2, "a 1."), (3, "7"), (4, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got == {1: ("en", 0.0), 2: ("en", 0.0), 3: ("und", 0.0), 4: ("und", 0.0)}


def _personal(rng, kind):
    """(base form, other forms) of a made-up value."""
    if kind == "email":
        user, host = "".join(rng.choices("abcdefgh", k=8)), "".join(rng.choices("klmnop", k=6)) + ".com"
        return f"{user}@{host}", [f"{user} (at) {host}", f"{user}[at]{host.replace('.', '[dot]')}"]
    if kind == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return ".".join(parts), [" . ".join(parts)]
    if kind == "card":
        d = "4" + "".join(rng.choices("0123456789", k=14))
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        return d, [".".join(re.findall(".{4}", d)), "/".join(re.findall(".{4}", d))]
    d = "49" + "".join(rng.choices("0123456789", k=9))
    return f"+{d[:2]} {d[2:5]} {d[5:]}", [f"{d[:2]} {d[2:5]} {d[5:]}"]


def _planted(rng, n):
    words = {"email": "mail", "ip": "ip", "card": "card", "phone": "tel"}
    base, planted, clean = [], [], []
    for i in range(n):
        kind = pii.KINDS[i % 4]
        own, others = _personal(rng, kind)
        base.append(f"Some words before. {words[kind]}: {own} and some words after it.")
        other = rng.choice(others)
        planted.append((kind, other, f"Some words before. {words[kind]}: {other} and some words after it."))
        clean.append(f"In {rng.randint(1900, 2020)} about {rng.randint(1, 9)}.{rng.randint(10, 99)} of {rng.randint(100, 999)},"
                     f"{rng.randint(100, 999)} items, {rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2020)}, "
                     f"version {rng.randint(1, 9)}.{rng.randint(0, 9)} meet @ noon, page {rng.randint(1, 500)}-{rng.randint(501, 999)}.")
    return base, planted, clean


def test_trees_add_planted_disguised_data_of_every_kind(spark):
    rng = random.Random(11)
    base, _, clean = _planted(rng, 600)
    judge = pii.train(docs_of(spark, base + clean))
    assert set(judge.thresholds) == set(pii.KINDS) and max(judge.thresholds.values()) < 1
    _, planted, fresh = _planted(random.Random(12), 200)
    docs = docs_of(spark, [t for _, _, t in planted] + fresh)
    found = {r.doc_id: r.pii for r in pii.find(docs, judge).collect()}
    right, added = dict.fromkeys(pii.KINDS, 0), 0
    for i, (kind, value, text) in enumerate(planted):
        at = text.index(value)
        spans = [s for s in found[i] if not s.base]
        right[kind] += any(s.start <= at and at + len(value) <= s.end for s in spans)
        added += len(spans)
    extra = sum(not s.base for i in range(200, 400) for s in found[i])
    print(right, added, extra)
    assert all(n >= 45 for n in right.values())                # recall 0.9 of 50 each
    assert sum(right.values()) >= 0.9 * (added + extra)        # precision


def test_selection_equals_a_plain_version(spark):
    rng = random.Random(13)
    base, planted, clean = _planted(rng, 120)
    judge = pii.train(docs_of(spark, base + clean))
    texts = [" ".join(rng.sample([t for _, _, t in planted] + base + clean, 4)) for _ in range(60)]
    for text in texts:
        own, added = pii.all_spans(text, judge)
        taken = [s for spans in own.values() for s in spans]
        scored = []
        for kind, s, e in set(pii.candidates(text)):
            x = np.array([pii.features(kind, text[s:e], text[max(0, s - 24):s], text[e:e + 24])])
            scored.append((-judge.probability(x)[0], s - e, s, e, kind))
        chosen = []
        for q, _, s, e, kind in sorted(scored):
            if -q >= judge.thresholds.get(kind, 2) and all(e <= a or b <= s for a, b in taken + [c[1:] for c in chosen]):
                chosen.append((kind, s, e))
        assert sorted(chosen) == sorted((k, *span) for k, spans in added.items() for span in spans)


def test_long_addresses_are_proposed_whole():
    text = f"write to {'a' * 200} (at) {'.'.join(['sub'] * 12)}.com now"
    assert (text[9:-4]) in {text[s:e] for _, s, e in pii.candidates(text)}
