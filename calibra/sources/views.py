"""Classification-shaped views derived from the test tables.

Every view is a lazy projection over a parquet scan, so column pruning and
filter pushdown reach the files.

* ``tx``     transactions: lineitem rows, 4 numeric features, ``Class``, drift side
* ``preds``  scored predictions: orders with three model scores and an A/B route
* ``log``    prediction log: events as scored requests
* ``runs``   run log: events as experiment runs
* ``model_version`` registry: suppliers as versions of a model per nation
* ``imbalanced`` embeddings with a 10 % minority class
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.columns import u01
from calibra.sources.tables import table

TX_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TX_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Fixed value: drift reference period ends here (exclusive).
DRIFT_SPLIT_DATE = "1998-07-01"
MODELS = ["a", "b", "c"]


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *TX_KEY, *TX_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("Class"),
        F.when(F.col("l_shipdate") < F.lit(DRIFT_SPLIT_DATE).cast("timestamp_ntz"), "reference")
        .otherwise("current").alias("side"),
    )


def _score(y: F.Column, weight_true: float, salt: str, key: F.Column) -> F.Column:
    return F.floor(F.lit(100.0) * (F.lit(weight_true) * y + F.lit(1.0 - weight_true) * u01(salt, key))) / 100.0


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds_from(table(spark, sf_dir, "orders"))


def preds_from(o: DataFrame) -> DataFrame:
    """``preds`` over any orders frame (batch or stream)."""
    key = F.col("o_orderkey")
    y = (F.col("o_orderstatus") == "F").cast("int")
    a = _score(y, 0.3, "a", key)
    b = _score(y, 0.4, "b", key)
    c = F.floor(F.lit(100.0) * u01("c", key)) / 100.0
    return o.select(
        key.alias("o_orderkey"),
        y.alias("y_true"),
        a.alias("score_a"), b.alias("score_b"), c.alias("score_c"),
        (a >= 0.5).cast("int").alias("pred_a"),
        (b >= 0.5).cast("int").alias("pred_b"),
        (c >= 0.5).cast("int").alias("pred_c"),
        (u01("ab", key) < 0.5).alias("route"),
        F.to_date("o_orderdate").alias("day"),
    )


def preds_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (key, model): the long prediction table of C1."""
    p = preds(spark, sf_dir)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("score"),
                 F.col(f"pred_{m}").alias("y_pred")) for m in MODELS]))
    return p.select("o_orderkey", "y_true", "day", "route", stacked.alias("_m")).select(
        "o_orderkey", "y_true", "day", "route", "_m.model", "_m.score", "_m.y_pred")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(table(spark, sf_dir, "events"))


def log_from(e: DataFrame) -> DataFrame:
    """``log`` over any events frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"),
        F.col("event_type"),
        (F.col("event_type") == "error").cast("int").alias("prediction"),
        F.col("value").alias("processing_time_ms"),
        k.alias("k"),
        (k / 100.0).alias("score"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("experiment"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.create_map(F.lit("value"), F.col("value"),
                     F.lit("k"), F.get_json_object("props", "$.k").cast("double")).alias("metrics"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("params"),
    )


# Registry stage by pmod(version, 3).
STAGES = ["None", "Staging", "Production"]


def model_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    stage = F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.pmod("s_suppkey", F.lit(3)).cast("int") + 1)
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("name"),
        F.col("s_suppkey").alias("version"),
        F.col("s_suppkey").alias("run_id"),
        stage.alias("current_stage"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp")
         + F.make_dt_interval(hours=F.col("s_suppkey").cast("int"))).alias("creation_timestamp"),
    )


def imbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("Class"),
    )
