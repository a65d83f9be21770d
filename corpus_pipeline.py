"""The corpus pipeline: from ``documents`` to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents; each works on all that
its predecessor kept.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import langid, pii
from calibra.llm.exact_dedup import drop_copies
from calibra.llm.minhash import drop_near_copies
from calibra.llm.packing import pack_documents
from calibra.llm.scratch import free_name, new_path
from calibra.sources.tables import table

#: a document goes when less than this share of its n-grams is known to its best language
LEAST_SCORE = 0.25

# the language filter is learned, the boosted trees too: no SQL gives these rows
ORACLE_SQL = None


def _beside(docs: DataFrame, names: tuple[str, ...], work) -> DataFrame:
    """``work(docs)``, which adds columns of these ``names``, with the documents' own columns of such
    names kept aside under free ones; the result's own columns come back as they were."""
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    out = work(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in none of the corpus' languages go."""
    model = langid.train(docs)
    return _beside(docs, ("lang_pred", "score"), lambda own: langid.identify(own, model).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the smallest doc_id stays."""
    return drop_near_copies(docs, shingle=5, percent=80)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    judge = pii.train(docs)
    return _beside(docs, ("pii", "redacted"), lambda own: pii.find(own, judge).withColumn("text", F.col("redacted")).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("pii", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
