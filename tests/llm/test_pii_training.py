"""PII trees and thresholds learn from every document (finding 3 of round 3)."""

import collections
import random
import zlib

import numpy as np
import pytest

from calibra.llm import pii


def texts_of(n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    parts = [lambda: f"{word()}@{word()}.com", lambda: f"call +1 {rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}",
             lambda: f"{rng.randint(1, 99)}.{rng.randint(100, 999999)}.{rng.randint(1, 9)}", lambda: "12 345 6789 01"]
    return [f"{word()} {rng.choice(parts)()} {word()}" for _ in range(n)]


def test_every_candidate_of_every_document_counts(spark):
    texts = [*texts_of(300), None, ""]
    texts += texts[:50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = collections.Counter((k, w, tuple(x), zlib.crc32(t.encode()) % 10 >= 7) for t in texts if t
                               for k, w, x in pii.labelled_rows(t))
    rows = pii.training_rows(docs).collect()
    assert collections.Counter((r.kind, r.what, tuple(r.x), r.held) for r in rows) == want


def test_thresholds_are_those_of_all_rows(spark):
    rng = np.random.default_rng(2)

    class Given(pii.Judge):
        def probability(self, x):
            return x[:, 0] / 40

    rows = [(kind, int(what), [float(p)] + [0.0] * (pii.FEATURES - 1), int(n), float(what != pii.NEGATIVE))
            for kind in ("email", "phone") for p, n, what in zip(rng.integers(0, 40, 300), rng.integers(1, 9, 300), rng.integers(0, 3, 300), strict=True)]
    rows += [("ip", pii.NEGATIVE, [1.0] + [0.0] * (pii.FEATURES - 1), 4, 0.0),
             ("card", pii.COPY, [7.0] + [0.0] * (pii.FEATURES - 1), 4, 1.0), ("card", pii.NEGATIVE, [8.0] + [0.0] * (pii.FEATURES - 1), 9, 0.0)]
    want = {}
    for kind in pii.KINDS:
        own = [r for r in rows if r[0] == kind and r[1] != pii.BASE]
        if any(r[4] for r in own):
            good = [p for p in {r[2][0] for r in own}
                    if sum(r[3] * r[4] for r in own if r[2][0] >= p) >= 0.6 * sum(r[3] for r in own if r[2][0] >= p)]
            want[kind] = min(good) / 40 if good else 2.0
    df = spark.createDataFrame([(k, w, x, y) for k, w, x, n, y in rows for _ in range(n)],
                               "kind string, what int, x array<double>, label double")
    got = pii.thresholds(df, Given(), 0.6)
    assert got == pytest.approx(want) and set(got) == {"email", "phone", "card"} and got["card"] == 2.0
