"""Token counts (operator 5): rollups maintained by signed deltas.

Totals by source, language and tokenizer version are never recomputed from the
documents: every batch of changes is reduced to signed sums and committed once.

    insert  (op 'I', tokens after)              ->  +1 document, +after
    delete  (op 'D', tokens before)             ->  -1 document, -before
    revise  (op 'U', tokens before and after)   ->   0 documents, after - before

A store is a folder of commits, each written under a name of its own and moved
into place by one rename.  A batch id that is already there is skipped, so
replays, retries and lost drivers add nothing twice.  Totals are the sum over
commits; ``compact`` folds them into one base commit, which remembers the batches
that it holds.

Defined results: null source, language or version are group values like any
other; null token counts count as 0; a repeated event inside a batch counts as
often as it occurs; groups whose totals are all zero stay (they show that
everything was taken back); an empty batch commits and changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# tokenizer versions: name -> counting expression over the text column
COUNTERS = {
    # runs of characters other than space and 0x09-0x0D
    "words-v1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    # letters-and-digits runs (ASCII) and every other visible character
    "words-v2": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long"),
}


def counted(docs: DataFrame, before: F.Column, after: F.Column, id_col: str = "doc_id",
            versions=tuple(COUNTERS)) -> DataFrame:
    """``id, source, lang, tokenizer, tokens_before, tokens_after`` per document and version.

    One scan; later joins move these few numbers and never the texts.
    """
    def count(version, text):
        return COUNTERS[version](F.coalesce(text.cast("string"), F.lit("")))

    rows = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count(v, before).alias("tokens_before"),
                              count(v, after).alias("tokens_after")) for v in versions])
    return docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.inline(rows))


def events(counts: DataFrame, op: str) -> DataFrame:
    """Change events: ``I`` brings the counts before any revision, ``D`` takes them back, ``U`` revises them."""
    before, after = F.col("tokens_before"), F.col("tokens_after")
    old, new = {"I": (F.lit(0), before), "D": (before, F.lit(0)), "U": (before, after)}[op]
    return counts.select(*KEYS, F.lit(op).alias("op"), old.cast("long").alias("tokens_before"),
                         new.cast("long").alias("tokens_after"))


def signed_totals(changes: DataFrame) -> DataFrame:
    """A batch's events as signed sums (combined map-side: one row per group and task is shuffled)."""
    sign = F.when(F.col("op") == "I", 1).when(F.col("op") == "D", -1).when(F.col("op") == "U", 0)
    known = F.when(sign.isNull(), F.raise_error(F.lit("op must be I, D or U"))).otherwise(sign)
    delta = F.coalesce(F.col("tokens_after"), F.lit(0)) - F.coalesce(F.col("tokens_before"), F.lit(0))
    return changes.groupBy(*KEYS).agg(F.sum(known).cast("long").alias("n_docs"),
                                      F.sum(delta).cast("long").alias("n_tokens"))


#: files of a commit that are no data: the batch's id, or the commits that a base stands for
ID_FILE, COVERS_FILE = "_id", "_covers"


class RollupStore:
    """Committed signed totals under one folder of a shared file system.

    A batch is the folder ``batch-<sha256 of its id>`` (ids may be any text), which holds the id in
    a file of its own.  A base, ``base-<number>``, lists the folders whose sums it holds; the one with
    the greatest number counts, together with the batches that it does not list.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[str]:
        root = self._hadoop.Path(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(root)) if n.startswith(f"{kind}-"))

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._hadoop.Path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._hadoop.Path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def batches(self) -> list[str]:
        """Ids of the batch commits that are in place (those folded into a base are not)."""
        return sorted(self._read_text(f"{self.path}/{f}/{ID_FILE}") for f in self._folders("batch"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of change events; False if that batch is already there."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        folder = f"batch-{hashlib.sha256(batch_id.encode()).hexdigest()}"
        if self._fs.exists(self._hadoop.Path(f"{self.path}/{folder}")) or folder in self._base()[1]:
            return False
        return self._put(folder, signed_totals(changes), ID_FILE, batch_id)

    def _put(self, folder: str, totals: DataFrame, name: str, text: str) -> bool:
        """Write a commit under a name of its own and rename it; False if another writer was first."""
        target = self._hadoop.Path(f"{self.path}/{folder}")
        attempt = f"{self.path}/_attempt-{uuid.uuid4().hex}"
        # as many rows as groups: few files, whatever the size of the batch
        totals.select(*KEYS, *TOTALS).coalesce(1).write.parquet(attempt)
        self._write_text(f"{attempt}/{name}", text)
        inside = self._hadoop.Path(f"{target}/{attempt.rsplit('/', 1)[1]}")
        placed = not self._fs.exists(target) and self._fs.rename(self._hadoop.Path(attempt), target)
        if placed and not self._fs.exists(inside):
            return True
        # a rename onto a folder that another writer has just placed fails or lands inside it
        first = self._fs.exists(target)
        self._fs.delete(self._hadoop.Path(attempt), True)
        self._fs.delete(inside, True)
        if not first:
            raise OSError(f"cannot place {target}")
        return False

    def _base(self) -> tuple[str | None, set[str]]:
        """(the newest base, the folders that it stands for)."""
        bases = self._folders("base")
        if not bases:
            return None, set()
        return bases[-1], set(self._read_text(f"{self.path}/{bases[-1]}/{COVERS_FILE}").split())

    def _live(self) -> tuple[list[str], set[str]]:
        """(commits to sum: the newest base and what it does not stand for, all folders they stand for)."""
        base, covered = self._base()
        own = [b for b in self._folders("batch") if b not in covered]
        return ([base] if base else []) + own, covered | set(own)

    def totals(self) -> DataFrame:
        """Current totals: the sum of all commits."""
        return self._sum(self._live()[0])

    def _sum(self, live: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in live]) if live \
            else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])

    def compact(self) -> None:
        """Fold all commits into one base; raises if another compaction is placed at the same time."""
        live, covered = self._live()
        bases = self._folders("base")
        if not live:
            return
        number = int(bases[-1][5:]) + 1 if bases else 1
        if not self._put(f"base-{number:09d}", self._sum(live), COVERS_FILE, "\n".join(sorted(covered))):
            raise RuntimeError("another compaction was placed at the same time")
        for f in [*bases, *[b for b in self._folders("batch") if b in covered]]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/{f}"), True)
