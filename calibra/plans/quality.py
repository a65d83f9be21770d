"""Queries for data quality and request handling (V*, P*) over ``tx`` and ``preds``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.operators import quality as Q
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V

_TX_COLS = [*V.TX_FEATURES, "Class"]


def _tx_table(spark, sf_dir):
    """The transaction table as the reference sees it: features + label, no key."""
    return V.tx(spark, sf_dir).select(*_TX_COLS)


@query("null_profile",
       sql=with_views("tx") + """
, w AS (SELECT """ + ", ".join(
           [f"count_if({c} IS NULL OR isnan({c})) AS {c}" for c in V.TX_FEATURES] + ["count_if(Class IS NULL) AS Class"])
       + """ FROM tx)
UNPIVOT w ON """ + ", ".join(_TX_COLS) + " INTO NAME column_name VALUE missing_count")
def null_profile(spark, sf_dir):
    """V3: missing (NULL or NaN) count per column."""
    return Q.missing_profile(_tx_table(spark, sf_dir))


_DUP_SQL = with_views("tx") + f"""
, g AS (SELECT {', '.join(_TX_COLS)}, count(*) AS c FROM tx GROUP BY ALL)
"""


@query("duplicate_rows",
       sql=_DUP_SQL + "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates, "
                      "count_if(c > 1) AS duplicate_groups FROM g")
def duplicate_rows(spark, sf_dir):
    """V5: rows beyond the first of each group of identical rows."""
    return Q.duplicate_rows(_tx_table(spark, sf_dir))


@query("validation_summary",
       sql=_DUP_SQL + """
, s AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS rows,
               CAST(coalesce(sum(""" + " + ".join(
           [f"CASE WHEN {x} IS NULL OR isnan({x}) THEN c ELSE 0 END" for x in V.TX_FEATURES]
           + ["CASE WHEN Class IS NULL THEN c ELSE 0 END"]) + """), 0) AS BIGINT) AS total_missing,
               CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM g)
SELECT rows, 5 AS columns, total_missing, duplicates, rows > 0 AS is_valid,
       CASE WHEN rows = 0 THEN ['DataFrame is empty']
            ELSE list_filter([CASE WHEN total_missing > 0 THEN 'Found ' || total_missing || ' missing values' END,
                              CASE WHEN duplicates > 0 THEN 'Found ' || duplicates || ' duplicate rows' END],
                             lambda x: x IS NOT NULL) END AS issues
FROM s""")
def validation_summary(spark, sf_dir):
    """V1-V6: one-row validation report of the transaction table."""
    return Q.validation_summary(_tx_table(spark, sf_dir), required=_TX_COLS, target="Class")


@query("class_distribution",
       sql=with_views("tx") + """
, g AS (SELECT Class AS label, count(*) AS n FROM tx GROUP BY Class)
SELECT label, n, n / sum(n) OVER () AS ratio FROM g""",
       rounded="ratio")
def class_distribution(spark, sf_dir):
    """V9: class counts and shares."""
    return Q.class_distribution(V.tx(spark, sf_dir), "Class")


def _requests(spark, sf_dir):
    """Score requests as feature maps; a feature whose value is 0 is left out of the request."""
    t = V.tx(spark, sf_dir)
    m = F.map_filter(F.create_map(*[x for f in V.TX_FEATURES for x in (F.lit(f), F.col(f))]),
                     lambda k, v: v != 0)
    return t.select(*V.TX_KEY, m.alias("features"))


_MISSING_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {f} <> 0 THEN NULL ELSE '{f}' END" for f in V.TX_FEATURES) + "], lambda x: x IS NOT NULL)"


@query("request_validation",
       sql=with_views("tx") + f"""
SELECT {', '.join(V.TX_KEY)}, {_MISSING_SQL} AS missing_features, len({_MISSING_SQL}) = 0 AS is_valid FROM tx""")
def request_validation(spark, sf_dir):
    """Required features absent from each request map."""
    r = _requests(spark, sf_dir)
    miss = Q.missing_features("features", V.TX_FEATURES)
    return r.select(*V.TX_KEY, miss.alias("missing_features"), (F.size(miss) == 0).alias("is_valid"))


@query("feature_fill",
       sql=with_views("tx") + f"""
SELECT {', '.join(V.TX_KEY)}, """ + ", ".join(f"CASE WHEN {f} <> 0 THEN {f} ELSE 0.0 END AS {f}"
                                              for f in V.TX_FEATURES) + " FROM tx",
       rounded=" ".join(V.TX_FEATURES))
def feature_fill(spark, sf_dir):
    """P5: absent features -> 0.0, columns in fixed order."""
    r = _requests(spark, sf_dir)
    return r.select(*V.TX_KEY, *Q.fill_features("features", V.TX_FEATURES))


@query("risk_bands",
       sql=with_views("preds") + """
SELECT o_orderkey, score_a AS probability,
       CASE WHEN score_a < 0.3 THEN 'low' WHEN score_a < 0.7 THEN 'medium' ELSE 'high' END AS confidence,
       CASE WHEN score_a > 0.7 THEN 'high' WHEN score_a > 0.3 THEN 'medium' ELSE 'low' END AS confidence_service,
       score_a * 100.0 AS risk_score, CAST(score_a >= 0.5 AS INTEGER) AS prediction
FROM preds""",
       rounded="probability risk_score")
def risk_bands(spark, sf_dir):
    """Confidence band (both boundary rules), risk score, thresholded decision."""
    p = V.preds(spark, sf_dir)
    return p.select("o_orderkey", F.col("score_a").alias("probability"),
                    Q.confidence_band("score_a").alias("confidence"),
                    Q.confidence_band("score_a", closed="right").alias("confidence_service"),
                    Q.risk_score("score_a").alias("risk_score"), Q.decide("score_a").alias("prediction"))


@query("tail_sample",
       sql=with_views("tx") + f"""
SELECT {', '.join(V.TX_KEY)}, Class FROM tx
ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1000""")
def tail_sample(spark, sf_dir):
    """The last 1000 transactions by key (a top-k: TakeOrdered, no global sort)."""
    t = V.tx(spark, sf_dir)
    return t.orderBy(*[F.desc(k) for k in V.TX_KEY]).limit(1000).select(*V.TX_KEY, "Class")


@query("feature_split",
       sql=with_views("tx") + f"""
SELECT {', '.join(V.TX_KEY)}, 'X' AS part, l_quantity, l_extendedprice, l_tax, CAST(NULL AS INTEGER) AS Class FROM tx
UNION ALL SELECT {', '.join(V.TX_KEY)}, 'y', NULL, NULL, NULL, Class FROM tx""",
       rounded="l_quantity l_extendedprice l_tax")
def feature_split(spark, sf_dir):
    """Numeric features without one column, and the target, as two projections."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, *V.TX_FEATURES, "Class")
    x, y = Q.split_features(t, "Class", V.TX_KEY, ["l_discount"])
    return x.withColumn("part", F.lit("X")).unionByName(y.withColumn("part", F.lit("y")), allowMissingColumns=True)


def _written(spark, name):
    from calibra.session import scratch_path

    return scratch_path(spark, f"files/{name}-{uuid.uuid4().hex}")


@query("csv_files",
       sql="""
SELECT s_suppkey AS id, CAST(s_suppkey * 0.5 AS DOUBLE) AS amount, s_suppkey % 2 AS Class, 'reference' AS side FROM supplier
UNION ALL SELECT s_suppkey, CAST(s_suppkey * 0.5 AS DOUBLE), s_suppkey % 2, 'current' FROM supplier WHERE s_suppkey % 3 = 0""",
       rounded="amount")
def csv_files(spark, sf_dir):
    """A table exported as CSV and scanned again as a drift pair, columns found by name."""
    from calibra.sources import files
    from calibra.sources.tables import table

    rows = table(spark, sf_dir, "supplier").select(
        F.lit("x").alias("note"), (F.col("s_suppkey") % 2).cast("int").alias("Class"), (F.col("s_suppkey") * 0.5).alias("amount"),
        F.col("s_suppkey").alias("id"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType()),
                           T.StructField("Class", T.LongType())])
    reference, current = _written(spark, "reference"), _written(spark, "current")
    files.export_csv(rows, reference)
    files.export_csv(rows.where("id % 3 = 0"), current)
    return files.reference_current(spark, reference, current, schema)


@query("jsonl_log",
       sql=with_views("log") + """
SELECT prediction, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT ts) AS BIGINT) AS times,
       sum(CAST(round(processing_time_ms * 100) AS BIGINT)) AS hundredths FROM log GROUP BY prediction""")
def jsonl_log(spark, sf_dir):
    """The prediction log appended as JSON lines in two batches and read back."""
    from calibra.sources import files

    log = V.log(spark, sf_dir)
    rows = log.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "prediction",
                      F.col("score").alias("confidence"), "processing_time_ms", "request_id")
    path = _written(spark, "log")
    for i in range(2):
        files.append_jsonl(rows.where(F.col("request_id") % 2 == i).drop("request_id"), path)
    back = files.read_jsonl(spark, path)
    return back.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("times"),
        F.sum(F.round(F.col("processing_time_ms") * 100).cast("bigint")).alias("hundredths"))


@query("request_decode",
       sql="""
SELECT event_id, 0 AS transaction_id,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0.0 AS amount,
       ['amount'] AS missing_features
FROM events""",
       rounded="k amount")
def request_decode(spark, sf_dir):
    """S11 + P4/P5: JSON request bodies decoded to feature maps, filled in fixed order."""
    from calibra.sources.files import decode_requests
    from calibra.sources.tables import table

    r = decode_requests(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body")))
    return r.select("event_id", "transaction_id", *Q.fill_features("features", ["k", "amount"]),
                    Q.missing_features("features", ["k", "amount"]).alias("missing_features"))


@query("head_sample",
       sql=with_views("tx") + f"""
SELECT {', '.join(V.TX_KEY)}, Class FROM tx
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""")
def head_sample(spark, sf_dir):
    """The first 1000 transactions by key (n is capped at the table size by LIMIT itself)."""
    t = V.tx(spark, sf_dir)
    return t.orderBy(*V.TX_KEY).limit(1000).select(*V.TX_KEY, "Class")
