"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import alignment, bpe, langid, ngram_lm, pii, rollup
from calibra.llm.chat import format_conversations
from calibra.llm.embeddings import near_vectors
from calibra.llm.exact_dedup import exact_dedup
from calibra.llm.minhash import near_duplicates
from calibra.llm.packing import pack_documents
from calibra.llm.repair import repair_conversations
from calibra.llm.scratch import new_path, stored
from calibra.llm.url_tree import judge_urls
from calibra.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql.strip()
        return fn

    return register


def remainder(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5: the fold of a document."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


@query()
def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of the documents whose fold is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.train(docs.where(remainder() != 1))
    return ngram_lm.score(docs, model).select(
        "doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the documents whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder() != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score")


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         regexp_replace(regexp_replace(coalesce(text, ''),
           '(\\*)(<</?(?:SYS|ROLE)>>|<<TEXT>>|\[/?INST\]|</?s>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS body
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                ELSE 25 + length(role) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(hostile).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    return format_conversations(rows.unionByName(extra))


@query("""
WITH counted AS (
  SELECT doc_id, source, lang, u.tokenizer, u.old AS old, u.new AS new
  FROM documents, LATERAL (
    SELECT 'words-v1' AS tokenizer,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS old,
           len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g'), '[^\x20\x09-\x0D]+')) AS new
    UNION ALL
    SELECT 'words-v2',
           len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')),
           len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g'),
                                  '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))) u),
flags AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source, lang, tokenizer,
       CAST(sum(CASE WHEN f.toxic = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN f.toxic = 1 THEN 0 WHEN f.quality = 0 THEN new ELSE old END) AS BIGINT) AS n_tokens
FROM counted LEFT JOIN flags f USING (doc_id) GROUP BY ALL
""")
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, toxic ones are taken out
    again, low-quality ones are revised (digits removed); every batch is sent twice."""
    text = F.col("text")
    counts = stored(rollup.counted(table(spark, sf_dir, "documents"), text,
                                   F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "")), "counts")
    flags = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(
        F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    labelled = counts.join(flags, "id")
    batches = {
        "0001-insert": rollup.events(counts, "I"),
        "0002-delete": rollup.events(labelled.where("toxic = 1"), "D"),
        "0003-revise": rollup.events(labelled.where("quality = 0 AND NOT toxic <=> 1"), "U"),
    }
    store = rollup.RollupStore(spark, new_path(spark, "rollup"))
    for _ in range(2):
        for batch_id, changes in batches.items():
            store.commit(batch_id, changes)
    return store.totals()


@query()
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all embeddings, and their components."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes that they decode to."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: 3-word shingles, similarity 0.85 confirmed on full sets."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=32, rows=8)


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; the largest doc_id of each group stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the boosted trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).select("doc_id", *pii.digest_columns())


#: rules of the URL filter: verdict, host, beginning of the path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def _url_sql(levels: int = 8) -> str:
    """The tree's levels written out one by one; paths of the test tables have at most 3 segments."""
    out = [r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM parts),
named AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label
  FROM ruled),
active0 AS (
  SELECT DISTINCT host, path, label, '' AS node, CASE path WHEN '' THEN [] ELSE str_split(path, '/')[2:] END AS segments
  FROM named)"""]
    for i in range(levels):
        out.append(f"""
going{i} AS (SELECT *, segments[{i + 1}] AS segment FROM active{i} WHERE len(segments) > {i}),
child{i} AS (
  SELECT host, node, segment, count(*) AS c, count(*) FILTER (label = 'block') AS b, count(*) FILTER (label = 'allow') AS a
  FROM going{i} GROUP BY ALL),
node{i} AS (SELECT host, node, sum(c) AS m FROM child{i} GROUP BY ALL HAVING sum(c) >= 4),
literal{i} AS (
  SELECT child{i}.*, lag(c) OVER w AS lc, lag(b) OVER w AS lb, lag(a) OVER w AS la
  FROM child{i} JOIN node{i} USING (host, node) WHERE c >= 2 AND c * c >= m
  WINDOW w AS (PARTITION BY host, node ORDER BY b / c, a / c, segment)),
chi{i} AS (
  SELECT *, lc IS NULL OR
    CASE WHEN b + lb > 0 THEN (lc * b - c * lb) ** 2 / (c * lc * (b + lb)) ELSE 0 END
    + CASE WHEN a + la > 0 THEN (lc * a - c * la) ** 2 / (c * lc * (a + la)) ELSE 0 END
    + CASE WHEN c - a - b + lc - la - lb > 0
           THEN (lc * (c - a - b) - c * (lc - la - lb)) ** 2 / (c * lc * (c - a - b + lc - la - lb)) ELSE 0 END > 5.991 AS apart
  FROM literal{i}),
part{i} AS (
  SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY host, node ORDER BY b / c, a / c, segment) AS part FROM chi{i}),
branch{i} AS (
  SELECT host, node, segment, min(segment) OVER g || CASE WHEN count(*) OVER g > 1 THEN '?' ELSE '' END AS branch
  FROM part{i} WINDOW g AS (PARTITION BY host, node, part)),
ended{i} AS (
  SELECT host, path, label, node AS template FROM active{i} WHERE len(segments) <= {i}
  UNION ALL SELECT host, path, label, node || '/??' FROM going{i} ANTI JOIN node{i} USING (host, node)),
active{i + 1} AS (
  SELECT g.host, g.path, g.label, g.node || '/' || coalesce(branch, '?') AS node, segments
  FROM going{i} g JOIN node{i} USING (host, node) LEFT JOIN branch{i} USING (host, node, segment))""")
    tree = " UNION ALL ".join(f"SELECT * FROM ended{i}" for i in range(levels))
    return ",".join(out) + f""",
tree AS ({tree}),
judged AS (
  SELECT host, template, (count(*) FILTER (label = 'block') + 1) / (count(label) + 2) AS purity FROM tree GROUP BY ALL)
SELECT page_id, host, path, rule, template, purity,
       coalesce(n.label, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n JOIN tree USING (host, path) JOIN judged USING (host, template)
"""


@query(_url_sql())
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, by rule or by the templates of its host."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of every document on which a byte-level BPE and a sentencepiece model agree, and
    how well the linked ids fit the corpus' counts."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with ``here``; crc32 of ``conv_id:turn`` modulo 20 says which are dropped (not here),
    emptied, cut off, repeated or given the user's role.  Nulls become one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("here"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


@query(r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(str_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                                                  || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
             lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS fate
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM named, LATERAL (SELECT unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
ends AS (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id),
insertion(x, y, cost, letters, body) AS (VALUES
  ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('0', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('a', 'u', 3, 'I', chr(10) || 'user:'),
  ('u', 'a', 3, 'I', chr(10) || 'assistant:'),
  ('0', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
legal(x, c, y) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
edit AS (
  SELECT p.conv_id, p.i, l.x, l.y, CASE WHEN cut THEN 3 ELSE 0 END AS cost, 'K' AS letters,
         chr(10) || role || ':' || text AS body
  FROM placed p JOIN legal l ON l.c = role[1] WHERE NOT blank AND NOT again
  UNION ALL
  SELECT p.conv_id, p.i, l.x, l.y, CASE WHEN cut THEN 6 ELSE 3 END, 'R',
         chr(10) || CASE l.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM placed p JOIN legal l ON l.c <> 's' WHERE NOT blank AND NOT again
  UNION ALL
  SELECT p.conv_id, p.i, d.x, d.x, 4, 'D', '' FROM placed p, (VALUES ('0'), ('s'), ('u'), ('a')) d(x)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS place, 0 AS cost, '' AS audit, '' AS body FROM ends
  UNION ALL
  SELECT conv_id, i, place, cost, audit, body FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.y AS place, w.cost + n.cost + e.cost AS cost,
           w.audit || n.letters || e.letters AS audit, w.body || n.body || e.body AS body
    FROM walk w JOIN insertion n ON n.x = w.place
    JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.x = n.y
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, e.y ORDER BY w.cost + n.cost + e.cost,
                                            w.audit || n.letters || e.letters) = 1)),
fixed AS (
  SELECT w.conv_id, w.cost + n.cost AS cost, w.audit || n.letters AS audit, w.body || n.body AS body
  FROM walk w JOIN ends d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.n = w.i
  JOIN insertion n ON n.x = w.place AND n.y IN ('0', 'a')
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.cost, w.audit || n.letters) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT blank AND NOT again) AS truncated,
         count_if(before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
""")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule and repaired at the least cost."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, F.col("here")).drop("n_rows")
