"""Streaming sources and bounded runners for tests and registered queries.

A table directory is read as a file stream (``pathGlobFilter`` picks one
table's files); new files arriving in the directory become new micro-batches.
``run_available`` drains what is there with ``trigger(availableNow=True)``
into a sink under the session's shared checkpoint folder and returns the sink
as a batch DataFrame.

``run_deliveries`` is the incremental form: data arrive in several deliveries, the
query is started for each of them from the same checkpoint and ends when it is
drained, as a scheduled job would.  State and watermarks live on between the runs,
so append mode puts out what each delivery closes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.session import path_exists, remove_path, scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files)
            .parquet(sf_dir))


def run_available(sdf: DataFrame, mode: str = "append", name: str = "stream",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming query over everything available, return its output as a batch frame.

    ``append``: parquet file sink (exactly-once through its commit log).
    ``complete``: each micro-batch rewrites the result table, which it carries whole.
    ``update``: each micro-batch is kept under its epoch (a replay rewrites its own) and
    the result holds the last row of every value of ``keys``.
    The query's checkpoint is removed when it has ended.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the result's key columns")
    spark = sdf.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    w = sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={_epoch}" if mode == "update" else out)

        q = w.foreachBatch(write).start()
    q.awaitTermination()
    remove_path(spark, ckpt)
    if not path_exists(spark, out):
        return spark.createDataFrame([], sdf.schema)
    if mode != "update":
        return spark.read.schema(sdf.schema).parquet(out)
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*sdf.columns), "epoch").alias("_last"))
    return last.select("_last.*")


def slices(df: DataFrame, ts: str, n: int) -> tuple:
    """(number of the time slice of a row, 0 to n - 1, as a column; first and last ``ts`` in microseconds).

    The range of ``ts`` is cut into n equal parts; one aggregation reads the range.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None or low == high:
        return F.lit(0), low, high
    return F.least(F.lit(n - 1), F.floor((at - low) * n / F.lit(high - low))).cast("int"), low, high


def run_deliveries(build, deliveries: dict[str, list[DataFrame]], name: str = "deliveries") -> DataFrame:
    """Deliver the i-th frames of all inputs, run the query until it is drained, and so on.

    ``build`` takes the streaming inputs by name and returns the streaming result, which is
    appended to a parquet sink.  Every delivery is written by a distributed job, so its files
    are as many as the frame's partitions; all inputs have the same number of deliveries.
    """
    first = next(iter(deliveries.values()))[0]
    spark = first.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    result = None
    for step in range(len(next(iter(deliveries.values())))):
        for key, parts in deliveries.items():
            parts[step].write.parquet(f"{base}/{key}/{step:06d}")
        inputs = {key: spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(f"{base}/{key}")
                  for key, parts in deliveries.items()}
        result = build(**inputs)
        result.writeStream.outputMode("append").option("checkpointLocation", ckpt).trigger(availableNow=True) \
            .format("parquet").option("path", out).start().awaitTermination()
    remove_path(spark, ckpt)
    for key in deliveries:
        remove_path(spark, f"{base}/{key}")
    return spark.read.schema(result.schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], result.schema)
