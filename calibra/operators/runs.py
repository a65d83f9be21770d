"""Run log and model-registry analytics (L1-L12, P11) as plain tables.

``runs``: ``run_id, experiment, start_time, metrics map<string,double>,
params map<string,string>`` (partitioned by experiment when written).
``model_version``: ``name, version, run_id, current_stage, creation_timestamp``.

Per-group top-N uses ``row_number() <= N``, which Spark plans with a
partial group limit before the shuffle, so a hot experiment ships at most N
rows per task.  Everything else is an aggregate (``max_by``/``min_by``) or an
equi-join on ``run_id``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.session import remove_path

NO_STAGE = "None"


def record_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """L1: append runs to a table partitioned by experiment (partition pruning on read)."""
    runs.write.mode(mode).partitionBy("experiment").parquet(path)


def to_metric_map(cols: Sequence[str]) -> Column:
    """Numeric values -> ``metrics`` map (NaN/inf excluded, they go to params)."""
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def to_param_map(cols: Sequence[str]) -> Column:
    """L1: anything else -> ``params`` map of strings (complex values as JSON)."""
    return F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])


def _newest(order_time: str = "start_time", key: str = "run_id") -> list[Column]:
    return [F.desc(order_time), F.asc(key)]


def recent_runs(runs: DataFrame, n: int = 10, experiment: str | None = None) -> DataFrame:
    """L2: newest ``n`` runs per experiment (or of one experiment)."""
    if experiment is not None:
        runs = runs.where(F.col("experiment") == experiment)
    w = Window.partitionBy("experiment").orderBy(*_newest())
    return runs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def runs_to_delete(runs: DataFrame, keep_last_n: int = 50) -> DataFrame:
    """L3: every run beyond the newest ``keep_last_n`` of its experiment.

    The keep set is a per-experiment top-N (partial limit before the shuffle);
    the rest is an anti-join against it, so no task ranks a whole experiment.
    """
    keep = recent_runs(runs, keep_last_n).select("run_id")
    return runs.join(keep, "run_id", "left_anti")


def export_runs(runs: DataFrame, metric_keys: Sequence[str], param_keys: Sequence[str] = ()) -> DataFrame:
    """L4: flatten metric/param maps to ``metrics.<k>`` / ``params.<k>`` columns (fixed key list)."""
    return runs.select(
        "run_id", "experiment", "start_time",
        *[F.try_element_at("metrics", F.lit(k)).alias(f"metrics_{k}") for k in metric_keys],
        *[F.try_element_at("params", F.lit(k)).alias(f"params_{k}") for k in param_keys])


def top_metric_keys(runs: DataFrame, n: int = 3) -> Column:
    """First ``n`` metric names (sorted) with a non-null value."""
    return F.slice(F.array_sort(F.map_keys(F.map_filter("metrics", lambda k, v: v.isNotNull()))), 1, n)


def latest_per_stage(versions: DataFrame, runs: DataFrame, metric: str = "value") -> DataFrame:
    """Newest version per (name, stage) with its run's metric."""
    latest = versions.groupBy("name", "current_stage").agg(
        F.max_by(F.struct("version", "run_id", "creation_timestamp"),
                 F.struct("creation_timestamp", "version")).alias("v"))
    latest = latest.select("name", "current_stage", "v.version", "v.run_id", "v.creation_timestamp")
    r = runs.select("run_id", F.try_element_at("metrics", F.lit(metric)).alias(metric))
    return latest.join(r, "run_id", "left")


def performance_history(versions: DataFrame, runs: DataFrame, metric: str = "value") -> DataFrame:
    """Every version with its run metric, ordered by creation time."""
    r = runs.select("run_id", F.try_element_at("metrics", F.lit(metric)).alias(metric))
    return versions.join(r, "run_id", "left").orderBy("name", "creation_timestamp", "version")


def metric_trend(history: DataFrame, metric: str = "value") -> DataFrame:
    """Latest, best, first, trend (+ if latest > first) per model; nulls dropped."""
    h = history.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    order = F.struct("creation_timestamp", "version")
    return h.groupBy("name").agg(
        F.max_by(metric, order).alias("latest"),
        F.max(metric).alias("best"),
        F.min_by(metric, order).alias("first"),
        F.count(F.lit(1)).alias("versions"),
    ).withColumn("trend", F.when(F.col("latest") > F.col("first"), "+").otherwise("-")).withColumn(
        "direction", F.when(F.col("latest") < F.col("first"), "DECLINING").otherwise("STABLE_OR_IMPROVING"))


def experiment_summary(runs: DataFrame, shown: int = 10) -> DataFrame:
    """Runs per experiment (and the dashboard's capped count), newest run id prefix, its metric keys."""
    latest = F.max_by(F.struct(F.col("run_id").cast("string").alias("rid"), top_metric_keys(runs).alias("keys")),
                      F.struct("start_time", F.negative(F.col("run_id"))))
    return runs.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("total_runs"), latest.alias("_l")).select(
        "experiment", "total_runs", F.least(F.col("total_runs"), F.lit(shown)).alias("shown_runs"),
        F.substring("_l.rid", 1, 8).alias("latest_run_prefix"), F.col("_l.keys").alias("key_metrics"))


def list_versions(versions: DataFrame) -> DataFrame:
    """Versions per model: count, newest, stages in use (bounded by the stage set)."""
    return versions.groupBy("name").agg(
        F.count(F.lit(1)).alias("versions"),
        F.max("version").alias("latest_version"),
        F.array_sort(F.collect_set("current_stage")).alias("stages"))


def promote_latest(versions: DataFrame, to_stage: str = "Staging") -> DataFrame:
    """Newest unstaged version of every model -> ``to_stage``; the registry rewritten."""
    cand = versions.where(F.col("current_stage") == NO_STAGE).groupBy("name").agg(
        F.max_by("version", F.struct("creation_timestamp", "version")).alias("version"))
    cand = cand.withColumn("_promote", F.lit(True))
    out = versions.join(cand, ["name", "version"], "left")
    return out.select("name", "version", "run_id",
                      F.when(F.col("_promote"), F.lit(to_stage)).otherwise(F.col("current_stage")).alias(
                          "current_stage"),
                      "creation_timestamp")


def set_tags(versions: DataFrame, chosen: Column, tags: dict[str, str | None]) -> DataFrame:
    """Versions with ``tags`` (map) merged where ``chosen``: a value sets its tag, None clears it,
    tags that are not named stay.  A table without a ``tags`` column gets one."""
    now = F.col("tags") if "tags" in versions.columns else F.create_map().cast("map<string,string>")
    now = F.coalesce(now, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(now, lambda k, _: ~k.isin(list(tags)))
    new = F.create_map(*[F.lit(x) for k, v in tags.items() if v is not None for x in (k, v)]).cast("map<string,string>")
    return versions.withColumn("tags", F.when(F.coalesce(chosen, F.lit(False)), F.map_concat(kept, new)).otherwise(now))


def mark_retraining(versions: DataFrame, should_retrain: bool, reasons: Sequence[str] = ()) -> DataFrame:
    """The newest production version of every model says that it needs retraining, and why; when it
    does not, both tags are cleared.  Other versions and tags stay as they are."""
    newest = versions.where(F.col("current_stage") == "Production").groupBy("name").agg(
        F.max("version").alias("_newest"))
    marked = versions.join(newest, "name", "left")
    tags = {"retraining_needed": "true" if should_retrain else None,
            "retraining_reasons": ", ".join(reasons) if should_retrain else None}
    return set_tags(marked, F.col("version") == F.col("_newest"), tags).drop("_newest")


def flag_production(versions: DataFrame, should_retrain: bool) -> DataFrame:
    """Production versions with the retraining decision (a scalar) as one more tag."""
    prod = versions.where(F.col("current_stage") == "Production")
    tagged = set_tags(prod, F.lit(True), {"needs_retraining": "true" if should_retrain else "false"})
    return tagged.select("name", "version", "run_id", F.to_json("tags").alias("tags"))


class RegistryConflict(RuntimeError):
    """Another writer committed a newer snapshot first."""


class VersionRegistry:
    """The table of model versions as numbered snapshots in one folder.

    A change reads the newest snapshot, writes the whole new table beside it and commits it by
    renaming its folder to the next number.  The rename fails when that number exists, so of
    two writers that began from the same snapshot one gets a :class:`RegistryConflict`; ``update``
    applies the change again to what the other one committed.  Readers only ever see
    whole snapshots.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            jvm.org.apache.hadoop.fs.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """Number of the newest snapshot; 0 when there is none."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n[9:]) for n in names if n.startswith("snapshot-")), default=0)

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshot-{self.latest() if number is None else number:09d}")

    def commit(self, table: DataFrame, base: int) -> int:
        """Make ``table`` snapshot ``base + 1``; raises :class:`RegistryConflict` if there is one."""
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        table.write.parquet(draft)
        path, options = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        try:
            self._files().rename(path(draft), path(f"{self.path}/snapshot-{base + 1:09d}"), none)
        except Exception as e:
            remove_path(self.spark, draft)
            if "FileAlreadyExists" in str(e):
                raise RegistryConflict(f"snapshot {base + 1} is already there") from e
            raise
        return base + 1

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 10) -> int:
        """Commit ``change`` of the newest snapshot, again and again while others commit first."""
        for _ in range(attempts):
            base = self.latest()
            try:
                return self.commit(change(self.read(base)), base)
            except RegistryConflict:
                continue
        raise RegistryConflict(f"no commit in {attempts} attempts")


def register_version(versions: DataFrame, name: str, run_id: int, created: Column) -> DataFrame:
    """Next version number for ``name`` as a one-row table to append."""
    return versions.where(F.col("name") == name).agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).select(
        F.lit(name).alias("name"), "version", F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(NO_STAGE).alias("current_stage"), created.alias("creation_timestamp"))
