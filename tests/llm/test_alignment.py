"""Alignment of two tokenizers against a plain version with the libraries themselves."""

import collections
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from calibra.llm import alignment
from calibra.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat.", "", None, " leading and  double   spaces ", "line\nbreaks\r\n\tand tabs", "▁ literal mark",
    "naïve café 漢字かな交じり文 emoji 🎉🎉 done", "a", "   ", "don't <|endoftext|> </s> <s> [INST]", "x y　z w", "a\0b c",
    "the the the the the cat", "word " * 3000, "0123456789 " * 400, "ab" * 20000, " " * 6000 + "end",
    "Words of all sorts, with commas; and marks: (like these) - and – those. " * 120,
]


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text, tok, sp):
    """[(ids of A, ids of B)] per group, or None where a document has no tokens."""
    if not text:
        return None
    letters = alignment.byte_letters()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
               for i in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ends_a, ends_b = (set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b))
    groups, at = [], [0, 0]
    for end in sorted(ends_a & ends_b):
        own = []
        for side, (ids, of) in enumerate(((a, bytes_a), (b, bytes_b))):
            taken, n = [], at[side]
            size = 0 if not groups else groups[-1][2]
            while size < end:
                size += len(of[n])
                taken.append(ids[n])
                n += 1
            at[side] = n
            own.append(taken)
        groups.append((*own, end))
    return [(x, y) for x, y, _ in groups]


def plain(rows, tok, sp):
    """Sorted result rows of (id, text) pairs."""
    groups = [plain_groups(t, tok, sp) for _, t in rows]
    count = collections.Counter((x[-1], y[-1]) for g in groups if g for x, y in g)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        if not g:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", *alignment.RESULT).collect()), key=repr)


@pytest.mark.parametrize("size", [97, 1000, 1 << 15])
def test_equals_plain(spark, libraries, size):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[0]), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(alignment.align(frame, A, B, size=size)) == plain(rows, *libraries)


def test_units_equal_plain(spark, libraries):
    """Texts cut at every kind of white space, with units that come once, often, and with bytes that B changes."""
    rng = random.Random(7)
    parts = ["the", "cat's", "Ünï", "漢字", "🎉", "▁", "e\u0301", "\u0308", "123", "<s>", "_", "...", "\0"]
    blanks = [" "] * 8 + ["  ", "   ", "\t", "\n", "\r\n", " \n", "\n ", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2029", "\u3000", ""]
    texts = []
    for i in range(300):
        few = [p for p in parts if p != "▁" or i % 5 == 0]
        texts.append(rng.choice(["", " ", "\n"]) + "".join(
            (rng.choice(few) if rng.random() < 0.9 else f"w{rng.random()}") + rng.choice(blanks) for _ in range(rng.randint(0, 30))))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain(rows, *libraries)
    assert got(alignment.align(frame, A, B)) == expected
    assert 0 < sum(r[1] == 0 for r in expected) < 150


def test_frequent_units_are_read_once(spark, libraries, monkeypatch):
    """Both tokenizers read words that come again from the table (they read every text whole before)."""
    texts = [" ".join(f"word{(i * 7 + j) % 40}," for j in range(50)) for i in range(60)] + ["once alone", None, "", "bad ▁ word0,"]
    frame = alignment.spaced_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    table = alignment.pair_table(frame.repartition(2), A, B, "text")
    p, read = alignment.pair(A, B), []
    both = p.both
    monkeypatch.setattr(p, "both", lambda text: read.append(text) or both(text))
    data, offsets = alignment.utf8(pa.array([None if not t else " " + t for t in texts]))
    n_a, n_b, n_groups, digests, links = alignment._whole_texts(p, table, data, offsets)
    assert sum(map(len, read)) < 100 < sum(len(t or "") for t in texts)
    wanted = plain(list(enumerate(texts)), *libraries)
    assert [(i, *x) for i, x in enumerate(zip(n_a, n_b, n_groups, digests, strict=True))] == \
        sorted((r[0], r[1], r[2], r[3], r[7]) for r in wanted)
    assert [len(alignment.unpacked(x)) for x in links] == n_groups and n_groups[-3:] == [0, 0, 0]


def test_undivided_where_a_token_holds_a_space(spark, libraries, monkeypatch):
    p = alignment.pair(A, B)
    assert p.cuttable
    raw = np.frombuffer(b" a b c ", dtype=np.uint8)
    assert [x.tolist() for x in alignment.spaced(raw, np.array([0, 0, 4, 7]))] == [[0, 2, 4], [2, 4, 7], [0, 0, 2, 3]]
    assert [x.tolist() for x in alignment.undivided(raw, np.array([0, 0, 4, 7]))] == [[0, 4], [4, 7], [0, 0, 1, 2]]
    monkeypatch.setattr(p, "cuttable", False)
    rows = [(i, t) for i, t in enumerate(TEXTS)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(alignment.align(frame, A, B)) == plain(rows, *libraries)


def test_query_equals_plain(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got(op12_token_alignment(spark, sf_dir)) == plain([tuple(r) for r in docs], *libraries)


def test_composition_is_associative_and_whole():
    rng = random.Random(1)
    p, cut_groups = alignment.pair(A, B), 0
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefg,.é漢") for _ in range(rng.randint(1, 12))) for _ in range(200))
        full = (" " + text).encode()
        found = [alignment.fragment_of(p, i, begin, end, at, full[at:to].decode())
                 for i, (begin, end, at, to) in enumerate(alignment.ranges(full, rng.choice([40, 97, 300])))]
        assert sum(f[0] for f in found) == len(p.both(text)[0])
        ones = [f[-1] for f in found]

        def tree(parts):
            if len(parts) <= 1:
                return parts[0] if parts else alignment.Fragment()
            cut = rng.randint(0, len(parts))
            return alignment.compose(tree(parts[:cut]), tree(parts[cut:])) if 0 < cut < len(parts) else tree(parts)

        def flat(one):
            return ([x.tolist() for x in (*one.prefix, *one.suffix)], one.first,
                    sorted((f, a.tolist(), b.tolist()) for f, a, b in one.joints))

        first, second = flat(tree(ones)), flat(tree(ones))
        assert first == second
        assert first[0][2] == first[0][3] == []          # the text's end is a common end
        cut_groups += sum(len(f[-1].suffix[0]) + len(f[-1].suffix[1]) > 0 for f in found)
    assert cut_groups > 10


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "one two", "mine", 5)], "doc_id long, text string, n_a string, key int")
    row = alignment.align(frame, A, B).first()
    assert row.n_a == 2 and row.key == 5 and row.n_groups > 0
    assert alignment.align(frame.limit(0), A, B).collect() == []


def test_only_byte_level_files(tmp_path):
    other = tmp_path / "a.json"
    with open(A, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = None
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Pair(str(other), B)
