"""Language ID (operator 2): language-bitmask n-gram filters.

Training counts byte n-grams of letters per language in Spark; the frequent
ones of each language are entered into a Bloom filter whose slots hold one bit
per language (bit-sliced: slot ``s`` of all languages' filters lies in one
machine word).  One lookup of an n-gram reads ``HASHES`` slots and ANDs them:
the result is the set of all languages that contain it.  A text's n-gram masks
are added up per language; each count is corrected for the filter's false
positives, ``(hits - n * f) / (1 - f)`` with ``f`` the n-gram false-positive
rate of that language's slice, and the largest share of hits decides.

N-grams.  Only A-Z are lower-cased; every ASCII byte that is no letter becomes a
space and runs of spaces become one; other bytes (UTF-8 of accents, other
scripts) stay.  So the n-grams see words, their ends and their accents.

Defined results: a null text or one without any letter gives ``und`` and score
0; so does every text when nothing could be learned.  Ties go to the language
that sorts first; a text too short for an n-gram (one letter) is such a tie, with score 0.  Texts of any length are read whole, in chunks of bounded
bytes.  Rows with a null language or text train nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.text import LOWER, U, chunks, map_batches, mix, utf8

GRAM = 4
HASHES = 2
UNKNOWN = "und"
#: bound of the training sample: documents per language (chosen by a hash of the id)
DOCS_PER_LANGUAGE = 4000
#: an n-gram enters a language's filter when it makes up this share of its n-grams
MIN_SHARE = 2e-5

ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[list(range(ord("a"), ord("z") + 1)) + list(range(ord("A"), ord("Z") + 1))] = True
FOLD = np.where(ASCII_LETTER | (np.arange(256) >= 128), LOWER, np.uint8(0x20)).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as uint64, index of each one's text) of the texts between the byte offsets."""
    base, end = int(offsets[0]), int(offsets[-1])
    n = len(offsets) - 1
    # every text gets one space before and after it
    total = (end - base) + 2 * n
    folded = np.full(total, 0x20, dtype=np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) + 2)
    place = np.ones(total, dtype=bool)
    bounds = (offsets[:-1] - base) + 2 * np.arange(n)
    place[bounds] = False
    place[(offsets[1:] - base) + 2 * np.arange(n) + 1] = False
    folded[place] = FOLD[data[base:end]]
    space = folded == 0x20
    keep = np.ones(total, dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds] = True
    folded, owner = folded[keep], owner[keep]
    m = len(folded) - GRAM + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int32)
    gram = folded[:m].astype(np.uint32)
    for i in range(1, GRAM):
        gram = (gram << np.uint32(8)) | folded[i:i + m]
    same = owner[:m] == owner[GRAM - 1:]
    return gram[same], owner[:m][same]


@dataclass
class LanguageFilter:
    """Slots with one bit per language; ``masks`` has one row of 64-bit words per slot."""

    languages: list[str]
    masks: np.ndarray            # (slots, ceil(languages / 64)) uint64
    false_rate: np.ndarray       # per language: chance that a foreign n-gram seems present

    @staticmethod
    def slots_of(gram: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(gram.astype(U))
        return [((h >> U(32 * i)) & U(size - 1)).astype(np.int64) for i in range(HASHES)]

    @classmethod
    def build(cls, members: dict[str, np.ndarray], bits_per_gram: int = 32) -> LanguageFilter:
        """``members``: language -> its n-grams.  The size follows the largest language."""
        languages = sorted(members)
        most = max((len(v) for v in members.values()), default=0)
        size = 1 << max(12, int(np.ceil(np.log2(max(1, most * bits_per_gram)))))
        masks = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=U)
        rates = []
        for i, lang in enumerate(languages):
            for slot in cls.slots_of(members[lang], size):
                masks[slot, i // 64] |= U(1 << (i % 64))
            filled = np.count_nonzero(masks[:, i // 64] & U(1 << (i % 64))) / size
            rates.append(filled ** HASHES)
        return cls(languages, masks, np.array(rates))

    def hits(self, gram: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Per text and language, how many of its n-grams the filter says the language contains."""
        out = np.zeros((n, len(self.languages)))
        slots = self.slots_of(gram, len(self.masks))
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            found = column[slots[0]]
            for s in slots[1:]:
                found = found & column[s]
            for i in range(64 * word, min(len(self.languages), 64 * word + 64)):
                bit = (found >> U(i % 64)) & U(1)
                out[:, i] = np.bincount(owner, weights=bit, minlength=n)
        return out

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index; score 0 to 1) per text; without an n-gram all languages tie at 0."""
        n = len(offsets) - 1
        gram, owner = grams(data, offsets)
        count = np.bincount(owner, minlength=n).astype(float)
        f = self.false_rate[None, :]
        corrected = np.clip((self.hits(gram, owner, n) - count[:, None] * f) / (1 - np.minimum(f, 0.999)), 0, None)
        best = corrected.argmax(axis=1)
        share = corrected[np.arange(n), best] / np.maximum(count, 1)
        return best, np.clip(share, 0, 1)


def has_letter(text: bytes) -> bool:
    """Whether the UTF-8 text holds any letter of any script."""
    if ASCII_LETTER[np.frombuffer(text, dtype=np.uint8)].any():
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


#: different labels that may be learned; each brings at most 1 / MIN_SHARE n-grams to the driver
MAX_LANGUAGES = 512


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_language: int = DOCS_PER_LANGUAGE, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Learn the filter from at most about ``per_language`` documents of each language.

    The sample is taken by a hash of the id against a rate from the exact
    document count of the language; n-gram counts are combined per task before
    the shuffle.  What reaches the driver are the n-grams that make up at least
    ``min_share`` of a language's: at most 1 / min_share per language.  A language of
    fewer n-grams than that enters with all of them.  More than ``MAX_LANGUAGES``
    different labels are an error.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"column {lang_col} holds more than {MAX_LANGUAGES} languages")
    sizes = {r["lang"]: r["n"] for r in found}
    if not sizes:
        return LanguageFilter.build({})
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < F.element_at(rate, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            names, codes = np.unique(np.array(b.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for lo, hi in chunks(offsets):
                gram, owner = grams(data, offsets[lo:hi + 1])
                packed, n = np.unique((codes[lo:hi][owner].astype(U) << U(32)) | gram.astype(U), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array(names[(packed >> U(32)).astype(np.int64)].tolist(), pa.string()),
                    "gram": (packed & U(0xFFFFFFFF)).astype(np.int64), "n": n.astype(np.int64)})

    counts = map_batches(sample.select("lang", "text"), count, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    least = F.create_map(*[F.lit(x) for r in per_lang for x in (r["lang"], min_share * r["n"])]) \
        if per_lang else None
    members: dict[str, list[int]] = {lang: [] for lang in sizes}
    if least is not None:
        for r in counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "gram").collect():
            members[r["lang"]].append(r["gram"])
    return LanguageFilter.build({k: np.array(sorted(v), dtype=np.uint32) for k, v in members.items()})


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (columns of these names are replaced); others stay as they are."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.masks, model.false_rate))      # bounded: see ``train``
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = LanguageFilter(*shared.value)
        names = np.array([*found.languages, UNKNOWN], dtype=object)
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            data, offsets = utf8(column)
            pred, score = [], []
            for lo, hi in chunks(offsets):
                n = hi - lo
                if found.languages:
                    best, share = found.decide(data, offsets[lo:hi + 1])
                else:
                    best, share = np.full(n, -1), np.zeros(n)
                letters = _letters(data, offsets[lo:hi + 1])
                best = np.where(letters, best, -1)
                pred.append(names[best])
                score.append(np.where(best >= 0, share, 0.0))
            pred_all = np.concatenate(pred).tolist() if pred else []
            score_all = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred_all, pa.string()), pa.array(score_all, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    return map_batches(docs, predict, schema)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: ASCII letters in one vector step, others by Unicode class."""
    base = int(offsets[0])
    total = np.concatenate([[0], np.cumsum(ASCII_LETTER[data[base:int(offsets[-1])]])])
    ascii_count = total[offsets[1:] - base] - total[offsets[:-1] - base]
    out = ascii_count > 0
    for i in np.flatnonzero(~out):
        out[i] = has_letter(data[offsets[i]:offsets[i + 1]].tobytes())
    return out
