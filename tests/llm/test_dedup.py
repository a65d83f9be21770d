"""Operators 6, 8 and 9 against brute force, and their defined results on odd input."""

import hashlib
import math
import random

import numpy as np
import pytest
from calibra.llm.components import components
from calibra.llm.embeddings import near_vectors, passes_for
from calibra.llm.exact_dedup import drop_copies, exact_dedup, misra_gries
from calibra.llm.minhash import drop_near_copies, near_duplicates, signature

DOCS = "doc_id long, text string, kept string, bucket int"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_misra_gries_keeps_every_frequent_value():
    rng = random.Random(1)
    values = [b"hot"] * 400 + [f"{rng.random()}".encode() for _ in range(600)]
    rng.shuffle(values)
    batches = [np.array(values[i:i + 37], dtype=object) for i in range(0, 1000, 37)]
    found = misra_gries(iter(batches), 4)
    assert len(found) <= 4
    assert 400 - 1000 / 5 <= found[b"hot"] <= 400


def test_exact_dedup_groups_and_odd_rows(spark):
    rows = [(1, "a", None, 0), (2, "a", None, 0), (3, None, None, 0), (4, "", "x", 1), (5, "b", None, None),
            (None, "a", None, 0), (None, "c", None, 0), (None, "c", None, 0), (7, "d", None, 0), (7, "d", None, 0)]
    rows += [(100 + i, "hot", None, 0) for i in range(50)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS), k=2).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_sha256"], []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r["keep_id"], r["group_size"]) for r in by_text[sha("a")]} == {(2, 3)}
    assert {(r["keep_id"], r["group_size"]) for r in by_text[sha("")]} == {(4, 2)}
    assert {(r["keep_id"], r["group_size"]) for r in by_text[sha("hot")]} == {(149, 50)}
    assert {(r["keep_id"], r["group_size"]) for r in by_text[sha("c")]} == {(None, 2)}
    assert all(sum(r["kept"] for r in g) == 1 for g in by_text.values())


def test_exact_dedup_keeps_columns_and_one_row_per_text(spark):
    rows = [(1, "a", "k1", 0), (2, "a", "k2", 1), (7, "d", "k3", 2), (7, "d", "k3", 2), (8, "e", None, None)]
    got = drop_copies(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "kept", "bucket"]
    assert sorted(tuple(r) for r in got.collect()) == [(2, "a", "k2", 1), (7, "d", "k3", 2), (8, "e", None, None)]


@pytest.mark.parametrize("op", [exact_dedup, near_duplicates, drop_copies, drop_near_copies])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], DOCS)).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [None, "", " \n\t", "One  two", "one TWO", "one", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), links)
    got = {r["doc_id"]: r for r in near_duplicates(docs, shingle=n, percent=percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in got)
    assert {r["doc_id"] for r in drop_near_copies(docs, shingle=n, percent=percent).collect()} == set(want.values())


def test_near_duplicates_of_a_large_family_equal_brute_force(spark):
    # members of one template, every fifth word in one of two forms: about 0.63 to each other, and twins
    # of about 0.86; every shingle has many holders, and buckets have hundreds of members
    rng = random.Random(11)
    words = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)] for _ in range(2)]
    texts = []
    for _ in range(300):
        form = [int(rng.random() < 0.25) for _ in range(80)]
        twin = list(form)
        for i in rng.sample(range(80), 10):
            twin[i] = 1 - twin[i]
        texts += [" ".join(words[f[i // 5] if i % 5 == 2 else 0][i] for i in range(400)) for f in (form, twin)]
    docs = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = near_duplicates(docs, shingle=3, percent=85, bands=16, rows=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(range(len(sets)), links)


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", None, 0), (1, "a b c d e f", None, 0), (2, "a b c d e f", None, 0), (2, "x y z", None, 0)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (2, 2)]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (160, 20, 20))
        x, y = (signature(np.sort(np.concatenate([common, z])), 64) for z in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 160 / 200) < 0.02


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for a, b in links if None not in (a, b) and a != b for x in (a, b)},
                 [(a, b) for a, b in links if None not in (a, b)])
    assert got == want


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = []
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            vecs.append((base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.25])).tolist())
    vecs += [vecs[0], vecs[0], [3.0 * v for v in vecs[1]], [0.0] * 16, None, [float("nan")] + [1.0] * 15,
             [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    usable = {i: np.array(v, dtype=float) for i, v in enumerate(vecs)
              if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    links = [(i, j) for i in usable for j in usable if j < i and len(usable[i]) == len(usable[j])
             and cosine(usable[i], usable[j]) >= 0.95]
    want = roots(range(len(vecs)), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    for window in (1024, 64):       # one block, then many passes over bounded windows
        got = {r["vec_id"]: r for r in near_vectors(df, window=window, recall=1 - 1e-9).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["n_links"] == sum(i in x for x in links) for i, r in got.items())


def test_near_vectors_in_dense_regions_equal_brute_force(spark, monkeypatch):
    # almost equal vectors (all sign bits tie) and a region of cosine about 0.93, both larger than the windows
    monkeypatch.setattr("calibra.llm.embeddings.BLOCK", 100)
    rng = np.random.default_rng(8)
    jitter = rng.standard_normal(16) + 1e-6 * rng.standard_normal((300, 16))
    region = rng.standard_normal(16) + 0.27 * rng.standard_normal((300, 16))
    x = np.concatenate([jitter, region, rng.standard_normal((900, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, links int")
    got = {r["vec_id"]: r for r in near_vectors(df, window=32, recall=1 - 1e-9).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_passes_grow_slowly():
    assert passes_for(500, 1024, 0.95, 0.9999) == 1
    assert passes_for(51_282, 1024, 0.95, 0.9999) < passes_for(10**9, 1024, 0.95, 0.9999) < 100


def test_near_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
