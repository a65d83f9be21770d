"""Units of texts, their table, and digests of byte-level BPE, on texts made to be hard to cut."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken
from calibra.llm import bpe, unit_table
from calibra.llm.text import IS_SPACE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", "th", "e", " ", "  ", "\n", "'s", "é", "漢", "😀", "12", "!!", "\t", " ", "　", "\x1c", "\r\n", "x" * 70, " the"]


def hard_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(n)]


def joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)


def test_word_runs_equal_the_pattern():
    texts = hard_texts(300, 1)
    raw, offsets = joined(texts)
    starts, ends, first = unit_table.word_runs(raw, offsets)
    for i, t in enumerate(texts):
        own = [raw[a:b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)]
        assert own == re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    assert not IS_SPACE[raw[starts]].any()


def test_spaced_runs_cover_texts_and_keep_pieces():
    import regex

    pattern, texts = regex.compile(public_tokenizers.PATTERN), hard_texts(500, 2)
    raw, offsets = joined(texts)
    starts, ends, first = unit_table.spaced_runs(raw, offsets)
    for i, t in enumerate(texts):
        own = [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)]
        assert "".join(own) == t
        assert [p for cut in own for p in pattern.findall(cut)] == pattern.findall(t)


def test_counts_and_hash_order():
    raw, offsets = joined(["the cat the", "cat dog"])
    starts, ends, _ = unit_table.word_runs(raw, offsets)
    keys, first, n = np.unique(unit_table.run_hashes(raw, starts, ends - starts, 0), return_index=True, return_counts=True)
    counted = unit_table._Counted()
    for _ in range(2):
        lengths = (ends - starts)[first]
        counted.add(keys, n, lengths, raw[unit_table.spread(starts[first], lengths)])
    merged, counts, lengths, data = counted.merge()
    begin = np.cumsum(lengths) - lengths
    words = {data[b:b + x].tobytes(): c for b, x, c in zip(begin, lengths, counts.tolist(), strict=True)}
    assert words == {b"the": 4, b"cat": 4, b"dog": 2} and (np.diff(merged.astype(object)) > 0).all()


def test_a_shard_is_merged_in_parts(spark):
    """A task that merges holds one part of its shard at once (it held the whole shard before)."""
    texts = [" ".join(f"w{i * 31 + j}" for j in range(200)) for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    blocks = unit_table.count_units(docs, "text", unit_table.word_runs, 2, 0).collect()
    places = [(r.shard, r.part) for r in blocks]
    assert set(places) == {(s, p) for s in range(2) for p in range(unit_table.PARTS)} and len(places) > len(set(places))
    for r in blocks:
        keys = np.frombuffer(r["keys"], dtype="<u8")
        assert set(unit_table.shard_of(keys, 2 * unit_table.PARTS).tolist()) == {r.shard * unit_table.PARTS + r.part}
    table = unit_table.build(docs, "text", unit_table.word_runs, lambda: lambda units: [np.array([int(u[1:])]) for u in units])
    raw, offsets = joined(texts)
    missing = []

    def encode(units):
        missing.extend(units)
        return [np.array([int(u[1:])]) for u in units]

    ids, sizes = unit_table.text_ids(table, raw, offsets, encode)
    assert ids.tolist() == [i * 31 + j for i in range(40) for j in range(200)] and sizes.tolist() == [200] * 40
    assert sorted(missing) == sorted(f"w{i}" for i in [*range(31), *range(39 * 31 + 169, 39 * 31 + 200)])


def test_digests_equal_tiktoken(spark):
    texts = hard_texts(400, 3) + [None, "", "a" * 20_000, " " * 3000 + "end", "same words " * 500] * 2
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    found = {r.doc_id: r for r in bpe.digests(docs.repartition(3), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = exact.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
