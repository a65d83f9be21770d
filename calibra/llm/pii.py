"""PII (operator 10): candidates, gradient-boosted trees, calibrated thresholds.

1. Base rules find e-mail addresses, IP addresses, card and phone numbers exactly
   (format plus check: octets, Luhn, digit counts).  Base spans always stay.
2. High-recall generators propose further spans that may overlap each other:
   written-out addresses, numbers with other separators, numbers without a plus,
   every run of neighbouring digit groups of a fitting length.
3. Boosted trees (``pyspark.ml``) judge each candidate by its format and context.
   They learn from the candidates of all documents: base spans and
   disguised copies of them (plus dropped, "@" written out, other separators) are
   positive, candidates that touch no base span negative, unless they pass their
   kind's own check (Luhn, octets, a word that announces a number, an address
   written out): such a one may well be real and teaches nothing.
4. On the documents that the trees have not seen (three tenths, by a hash of the text), each kind gets the
   smallest threshold that keeps the wanted precision among disguised copies and
   negatives (a threshold is never applied to base spans); a kind without one adds
   nothing.  Selected candidates that overlap a base span or a better candidate
   are dropped.

The trees are a few hundred numbers and go to the tasks, so finding and
redacting is one pass over the texts without any join or shuffle.

Defined results: a null text counts as empty and has no spans; texts of any
length are searched whole, in linear time; offsets count code points, ends are
exclusive; repeated rows are judged alone; an empty table gives an empty result;
columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.prefix import cumulative_counts
from calibra.llm.scratch import stored
from calibra.llm.text import map_batches

KINDS = ("email", "ip", "card", "phone")
#: training rows that a task hands over at once
TRAIN_BATCH = 5_000
#: training rows of a partition
FIT_ROWS = 250_000
PRECISION = 0.98

# --- base rules ----------------------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (?<![0-9]): a later start inside the same digits could not succeed either
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each "@" outwards (linear in the text)."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        elif start < at:
            floor = at           # no address ends its local part before this sign
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base rules by kind, in order of their start."""
    found = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# --- candidates ----------------------------------------------------------------------

AT = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
LOCAL_PART = re.compile(r"[\w.%+-]")
RIGHT = re.compile(r"\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]{2,63})+", re.IGNORECASE)
DIGITS = re.compile("[0-9]+")
GAP = re.compile(r"[ ().,/-]*")
QUAD = re.compile(r"[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}\Z")
# fixed values: words that announce personal data
TRIGGERS = re.compile(r"(?:tel|phone|fon|fax|call|mobile|móvil|handy|card|karte|tarjeta|carte|visa|mail|correo|ip|"
                      r"addr|contact|kontakt|contacto)\w*\W{0,3}\Z", re.IGNORECASE)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Proposed spans; they may overlap, and they include what the base rules find."""
    floor = 0
    for m in AT.finditer(text):
        # one blank may stand before the sign; the local part ends where the sign before it did at most
        end = m.start() - (m.start() > floor and text[m.start() - 1].isspace())
        start = end
        while start > floor and LOCAL_PART.match(text[start - 1]):
            start -= 1
        right = RIGHT.match(text, m.end()) if start < end else None
        if right:
            yield "email", start, right.end()
        floor = m.end()
    if not DIGIT.search(text):
        return
    groups = [m.span() for m in DIGITS.finditer(text)]
    # whether a group belongs with the one before it
    joined = [i > 0 and bool(GAP.fullmatch(text, groups[i - 1][1], start)) for i, (start, _) in enumerate(groups)]
    for i, (start, _) in enumerate(groups):
        if start and text[start - 1] in "+(":
            start -= 1
        count, opened = 0, False
        # a window of at most 19 digits from every group on
        for j in range(i, len(groups)):
            if j > i and not joined[j]:
                break
            first, end = groups[j]
            count += end - first
            if count > 19:
                break
            opened = opened or "(" in text[start if j == i else groups[j - 1][1]:first]
            if opened and text[end:end + 1] == ")":
                end += 1
            if count >= 13:
                yield "card", start, end
            if 8 <= count <= 15:
                yield "phone", start, end
            if 4 <= count <= 12 and QUAD.match(text, start, end):
                yield "ip", start, end


FEATURES = 20


def features(kind: str, value: str, before: str, after: str) -> list[float]:
    """Format of the value and its context (up to 24 characters on each side)."""
    d = digits_of(value)
    parts = [p for p in re.split("[^0-9]+", value) if p]
    small = [int(p) for p in parts if len(p) <= 4]
    return [
        *(float(kind == k) for k in KINDS), float(len(value)), float(len(d)), float(len(parts)),
        float(sum(not c.isalnum() for c in value)), float(value.count(".")), float(value.startswith("+")),
        float("(" in value), float("@" in value), float(len(d) >= 13 and luhn(d)),
        float(max(small, default=0)), float(max(map(len, parts), default=0)),
        float(not before or before[-1].isspace()), float(not after or after[0].isspace() or after[0] in ".,;)"),
        float(sum("0" <= c <= "9" for c in before)), float(sum("0" <= c <= "9" for c in after)),
        float(bool(TRIGGERS.search(before))),
    ]


def context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 24):start], text[end:end + 24]


def disguises(kind: str, value: str) -> list[str]:
    """A base span written in ways that the base rules do not find."""
    d = digits_of(value)
    if kind == "email":
        user, _, host = value.partition("@")
        return [f"{user} (at) {host}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user} @ {host}"]
    if kind == "phone":
        return [value.removeprefix("+"), d, "/".join(re.findall(".{1,4}", d))]
    if kind == "card":
        return [".".join(re.findall(".{1,4}", d)), "/".join(re.findall(".{1,4}", d))]
    return [value.replace(".", " . "), value.replace(".", " .")]


def plausible(kind: str, value: str, before: str) -> bool:
    """Whether a candidate passes its kind's own check, in whatever form it is written."""
    d = digits_of(value)
    if kind == "email":
        sign = AT.search(value)
        return sign[0] != "@" or not any(c.isspace() for c in value[sign.end():].strip())
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return all(int(x) <= 255 for x in DIGITS.findall(value))
    return bool(TRIGGERS.search(before))


# --- the model -----------------------------------------------------------------------


@dataclass
class Judge:
    """Boosted trees as arrays: per node the feature (-1: leaf), threshold, children and value."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, which, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            inner = which[at] >= 0
            while inner.any():
                goes = x[np.arange(len(x)), np.maximum(which[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
                inner = which[at] >= 0
            margin += weight * value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def _arrays(model) -> list:
    """The fitted trees' nodes, read once from the JVM."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append(None)
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, 0, 0, node.prediction())
            else:
                split = node.split()
                low, high = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (split.featureIndex(), split.threshold(), low, high, 0.0)
            return at

        walk(tree._call_java("rootNode"))
        columns = list(zip(*nodes, strict=True))
        out.append((weight, *(np.array(c) for c in columns)))
    return out


def merged(spans) -> list[tuple[int, int]]:
    """The spans' union as separate spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def overlaps(a: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether ``a`` meets one of the spans, which are separate and in order."""
    at = bisect_left(spans, (a[1],))
    return at > 0 and a[0] < spans[at - 1][1]


#: what a training row is: a base span, a disguised copy of one, or a candidate that is none
BASE, COPY, NEGATIVE = 0, 1, 2


def labelled_rows(text: str) -> Iterator[tuple[str, int, list[float]]]:
    """(kind, what it is, features) of a training text."""
    base = base_spans(text)
    every = merged(s for spans in base.values() for s in spans)
    for kind, spans in base.items():
        for start, end in spans:
            around = context(text, start, end)
            yield kind, BASE, features(kind, text[start:end], *around)
            for value in disguises(kind, text[start:end]):
                yield kind, COPY, features(kind, value, *around)
    for kind, start, end in set(candidates(text)):
        if not overlaps((start, end), every):
            before, after = context(text, start, end)
            if not plausible(kind, text[start:end], before):
                yield kind, NEGATIVE, features(kind, text[start:end], before, after)


def training_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, what, x, held``: every training row of all documents."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.bool_())],
            names=["kind", "what", "x", "held"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for t in b.column("text").to_pylist():
                # a document is wholly in the fitting or in the calibrating part
                held = zlib.crc32(t.encode()) % 10 >= 7
                for r in labelled_rows(t):
                    rows.append((*r, held))
                    if len(rows) >= TRAIN_BATCH:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return map_batches(texts, collect, "kind string, what int, x array<double>, held boolean")


def train(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Judge:
    """Fit the trees and the thresholds on the candidates of all documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = stored(training_rows(docs, text_col), "candidates").withColumn("label", (F.col("what") != NEGATIVE).cast("double"))
    fit_on = rows.where(~F.col("held")).select("label", array_to_vector("x").alias("features"))
    n = fit_on.count()
    if fit_on.select("label").distinct().count() < 2:
        return Judge()
    # every tree takes several jobs over the rows: few partitions while they are few
    fit_on = fit_on.repartition(max(4, -(-n // FIT_ROWS)))
    judge = Judge(_arrays(GBTClassifier(maxIter=12, maxDepth=4, seed=7).fit(fit_on)))
    judge.thresholds = thresholds(rows.where("held"), judge, precision)
    return judge


def thresholds(unseen: DataFrame, judge: Judge, precision: float) -> dict[str, float]:
    """Per kind with copies the smallest probability from which on the wanted share of ``unseen`` rows
    (copies and negatives) is positive; 2 if there is none."""
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(-judge.probability(x)), b.column("label")],
                                             names=["kind", "p", "label"])

    rated = map_batches(unseen.where(F.col("what") != BASE).select("kind", "x", "label"), rate,
                        "kind string, p double, label double")
    sums = cumulative_counts(stored(rated, "rated"), ["kind"], "p", {"all": F.count(F.lit(1)), "right": F.sum("label")})
    good = F.col("cum_right") / F.col("cum_all") >= precision
    best = sums.groupBy("kind").agg(F.max(F.when(good, F.col("p"))).alias("p"), F.max("tot_right").alias("copies")).collect()
    return {r["kind"]: 2.0 if r["p"] is None else -r["p"] for r in best if r["copies"]}


# --- use -----------------------------------------------------------------------------


def all_spans(text: str, judge: Judge) -> tuple[dict, dict]:
    """(base spans, added spans) by kind."""
    base = base_spans(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not judge.trees:
        return base, added
    taken = merged(s for spans in base.values() for s in spans)
    proposed = [c for c in set(candidates(text)) if not overlaps(c[1:], taken)] if taken else list(set(candidates(text)))
    if not proposed:
        return base, added
    p = judge.probability(np.array([features(k, text[s:e], *context(text, s, e)) for k, s, e in proposed]))
    chosen = sorted((-q, s - e, s, e, k) for q, (k, s, e) in zip(p.tolist(), proposed, strict=True)
                    if q >= judge.thresholds.get(k, 2.0))
    ends: list[tuple[int, int]] = []
    for _, _, s, e, kind in chosen:
        if not overlaps((s, e), ends):
            insort(ends, (s, e))
            added[kind].append((s, e))
    return base, added


def listed(spans: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """Add ``pii``: array of (kind, start, end, base) by kind and start, and ``redacted``: the text
    with every span replaced by its kind in brackets."""
    docs = docs.drop(*[c for c in ("pii", "redacted") if c != text_col])
    spans = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    schema = docs.select("*", F.lit(None).cast(spans).alias("pii"), F.lit(None).cast("string").alias("redacted")).schema
    shared = docs.sparkSession.sparkContext.broadcast(judge)       # a few hundred numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                lists, texts = [], []
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    base, added = all_spans(text or "", model)
                    lists.append([{"kind": k, "start": s, "end": e, "base": own} for k in KINDS
                                  for s, e, own in sorted([(*x, True) for x in base[k]] + [(*x, False) for x in added[k]])])
                    texts.append(redact(text, lists[-1]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lists, pa.list_(SPAN)), pa.array(texts, pa.string())],
                    names=[*part.schema.names, "pii", "redacted"])

    return map_batches(docs, work, schema)


def redact(text: str | None, spans: list[dict]) -> str | None:
    """Spans that overlap are replaced together, by the kind that begins first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def digest_columns() -> list[F.Column]:
    """``n_email`` to ``n_phone``, ``base_sha256`` and ``spans`` from the ``pii`` column."""
    as_text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return [*[count(k).alias(f"n_{k}") for k in KINDS],
            F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans")]


def fingerprint(spans: dict) -> str:
    """SHA-256 of the listed spans, as ``digest_columns`` gives it."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()
