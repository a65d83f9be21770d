"""File sources and sinks.

Scans use explicit schemas (no inference pass) and ``FAILFAST`` so a bad
record fails the job instead of silently becoming NULLs; sinks are plain
DataFrame writers, partitioned where a later reader filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The transaction file layout (Time, V1..V28, Amount, Class).
TX_FEATURES = [f"V{i}" for i in range(1, 29)] + ["Amount"]
TX_COLUMNS = ["Time", *TX_FEATURES, "Class"]
TRANSACTION_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ["Time", *TX_FEATURES]] + [T.StructField("Class", T.IntegerType())])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("prediction", T.IntegerType()), T.StructField("true_label", T.IntegerType()),
    T.StructField("prob_normal", T.DoubleType()), T.StructField("prob_fraud", T.DoubleType())])
PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("prediction", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("processing_time_ms", T.DoubleType())])
FEATURE_MAP = T.MapType(T.StringType(), T.DoubleType())


class EmptyDataError(ValueError):
    """The file exists but holds no rows."""


class MissingColumnsError(ValueError):
    """The header lacks columns that the schema names."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hpath)) and len(fs.globStatus(hpath)) > 0


def _by_header(reader, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns, found by the header's names in any order; other columns are
    not read.  Files whose headers differ from the first one's fail (enforceSchema off)."""
    header = spark.read.option("header", True).csv(path).columns
    wanted = {f.name: f for f in schema.fields}
    lacking = [n for n in wanted if n not in header]
    if lacking:
        raise MissingColumnsError(f"missing columns: {lacking}")
    in_file = T.StructType([wanted.get(n, T.StructField(n, T.StringType())) for n in header])
    return reader.option("enforceSchema", False).schema(in_file).csv(path).select(*wanted)


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = TRANSACTION_SCHEMA,
             check_empty: bool = True) -> DataFrame:
    """CSV with header and an explicit schema, FAILFAST on malformed rows.

    Missing path -> ``FileNotFoundError``; no rows -> ``EmptyDataError``; a header that
    lacks columns -> ``MissingColumnsError`` with their names; an unreadable layout -> ``ValueError("Invalid file format")``.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    try:
        df = _by_header(reader, spark, path, schema) if schema is not None else reader.csv(path)
        # parse the first row completely: an empty file or a broken layout fails here
        if check_empty and not df.limit(1).collect():
            raise EmptyDataError(f"No rows in {path}")
    except (EmptyDataError, MissingColumnsError):
        raise
    except Exception as e:  # noqa: BLE001 - any parse failure is reported as a bad format
        raise ValueError("Invalid file format") from e
    return df


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S1 (columnar): pruning and pushdown reach the files."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def reference_current(spark: SparkSession, ref_path: str, cur_path: str,
                      schema: T.StructType | None = TRANSACTION_SCHEMA) -> DataFrame:
    """S3: the drift pair as one frame tagged by ``side`` (one scan of each)."""
    r = load_csv(spark, ref_path, schema).withColumn("side", F.lit("reference"))
    c = load_csv(spark, cur_path, schema).withColumn("side", F.lit("current"))
    return r.unionByName(c)


def append_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append prediction events as JSON lines."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_LOG_SCHEMA,
               stream: bool = False) -> DataFrame:
    """Prediction log as a batch or a stream (explicit schema; ``ts`` parsed)."""
    r = (spark.readStream if stream else spark.read).schema(schema)
    df = r.json(path)
    return df.withColumn("ts", F.to_timestamp("timestamp"))


def write_report(df: DataFrame, path: str, run_date: Column | None = None) -> None:
    """Report rows as JSON, partitioned by run date."""
    d = df.withColumn("run_date", run_date if run_date is not None else F.current_date())
    d.write.mode("append").partitionBy("run_date").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def decode_requests(raw: DataFrame, col: str = "body") -> DataFrame:
    """JSON request bodies -> ``map<string,double>`` feature column.

    A body that is one object gives one request; a JSON array of objects gives
    one row per element (batch request, ``transaction_id`` = position).
    """
    body = F.trim(F.col(col))
    single = F.from_json(body, FEATURE_MAP)
    many = F.from_json(body, T.ArrayType(FEATURE_MAP))
    arr = F.when(body.startswith("["), many).otherwise(F.array(single))
    return raw.select("*", F.posexplode_outer(arr).alias("transaction_id", "features"))
