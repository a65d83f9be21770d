"""Operator 3 (exact small optima, tokens against the library) and the pipeline's stages."""

import itertools
import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from calibra.llm import packing, pii
from calibra.llm.minhash import drop_near_copies
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """The optimum by exhaustive search."""

    @lru_cache(maxsize=None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = math.inf
        for k in range(len(rest) + 1):
            for extra in itertools.combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in extra) <= capacity:
                    out = min(out, 1 + best(tuple(x for i, x in enumerate(rest) if i not in extra)))
        return out

    return best(tuple(sorted(sizes, reverse=True)))


def used(patterns):
    return sum(m for _, m in patterns)


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, rest = packing.reduce_by_dominance(Counter(sizes), capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert used(fixed) + fewest(left, capacity) == fewest(sizes, capacity), sizes


def test_patterns_hold_every_piece_and_fit():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 2048) for _ in range(rng.randint(0, 3000)))
        patterns = packing.solve(counts)
        got = Counter()
        for lengths, many in patterns:
            assert sum(lengths) <= 2048 and many > 0
            for w in lengths:
                got[w] += many
        assert got == counts
        total = sum(w * n for w, n in counts.items())
        least = max(math.ceil(total / 2048), sum(n for w, n in counts.items() if w > 1024))
        assert least <= used(patterns) <= 11 / 9 * least + 1


def test_tokens_equal_the_library(spark):
    texts = ["Hello  World", None, "", "a b c", "<|endoftext|> x", "É é " * 3000, "x" * 5000, "it's 12 o'clock\n\n\tnow"]
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in packing.pieces(docs, PATH, with_ids=True).collect())
    want = []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            body = np.array(ids[s:s + 2048], dtype="<u4").tobytes()
            want.append((i, k, s, len(body) // 4, zlib.crc32(body), bytearray(body)))
    assert got == want


def test_places_are_gapless(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.choice([700, 700, 700, rng.randint(1, 2048)]), 1, "x") for i in range(800)] + [(None, 0, 0, 5, 1, "x")] * 2
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, k string")
    got = packing.pack(items).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == len(rows)
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(1, 3000)], "doc_id long, length long"))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**9, "123 456", "en", "s", 7), (10**9 + 1, None, "en", "s", 0),
                                   (10**9 + 2, "the words of the and that to in " * 3 + "write to joe@mail.com", "en", "s", 1)],
                                  docs.schema)
    now = docs.unionByName(extra)
    before = {r["doc_id"]: r["text"] for r in now.collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        rows[name] = now.collect()
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = {name: {r["doc_id"] for r in got} for name, got in rows.items()}
    assert ids["language_id"] == before.keys() - {10**9, 10**9 + 1}
    largest = {}
    for i in ids["language_id"]:
        largest[before[i]] = max(i, largest.get(before[i], i))
    assert ids["exact_dedup"] == set(largest.values())
    sets = {i: shingles(before[i]) for i in ids["exact_dedup"]}
    kept = set(sets)
    index, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in index.get(s, ()))
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    kept = {find(i) for i in sets}
    assert ids["minhash_dedup"] == kept == ids["pii"] == ids["best_fit_packing"]
    texts = {r["doc_id"]: r for r in rows["pii"]}
    assert "joe@mail.com" not in texts[10**9 + 2]["text"]
    for i, r in texts.items():
        assert not any(pii.base_spans(r["text"]).values())
        assert r["n_chars"] == len(r["text"])
        if not any(pii.base_spans(before[i]).values()) and not any(c.isdigit() for c in before[i]) and "@" not in before[i]:
            assert r["text"] == before[i]
    assert sum(r["length"] for r in rows["best_fit_packing"]) > 0


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "*", F.lit("mine").alias("Score"), F.lit(1.5).alias("pii"), F.lit(7).alias("redacted"), F.lit("x").alias("lang_pred"),
        F.lit("s").alias("_share"), F.lit(3).alias("own_score"))
    for name in ("language_id", "pii", "minhash_dedup", "exact_dedup"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        own = out.select("Score", "pii", "redacted", "lang_pred", "_share", "own_score").distinct().collect()
        assert [tuple(r) for r in own] == [("mine", 1.5, 7, "x", "s", 3)], name


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [], name


def test_near_copies_of_one_id_go_by_their_own_text(spark):
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words), " ".join(reversed(words))
    rows = [(1, first), (2, first + " more"), (2, second), (2, second), (None, first), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in drop_near_copies(docs).collect()), key=repr)
    assert kept == sorted([(1, first), (2, second), (2, second), (None, first), (3, None)], key=repr)
