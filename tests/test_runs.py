"""Run log and registry tables."""

import datetime as dt

from pyspark.sql import functions as F

from calibra.operators import runs as R


def _runs(spark):
    rows = [(1, "training", dt.datetime(2024, 1, 1), {"f1": 0.8}), (2, "training", dt.datetime(2024, 1, 2), {"f1": 0.9}),
            (3, "monitoring", dt.datetime(2024, 1, 3), {"f1": None})]
    return spark.createDataFrame(rows, "run_id long, experiment string, start_time timestamp, metrics map<string,double>")


def test_retention_deletes_exactly_the_older_run(spark):
    d = R.runs_to_delete(_runs(spark).where("experiment = 'training'"), keep_last_n=1).collect()
    assert [r.run_id for r in d] == [1]


def test_recent_runs_newest_first(spark):
    r = R.recent_runs(_runs(spark), 1).collect()
    assert sorted(x.run_id for x in r) == [2, 3]


def test_top_metric_keys_skips_nulls(spark):
    df = _runs(spark)
    got = {r.run_id: r.k for r in df.select("run_id", R.top_metric_keys(df).alias("k")).collect()}
    assert got[1] == ["f1"] and got[3] == []


def _versions(spark):
    rows = [("fraud", 1, 1, "None", dt.datetime(2024, 1, 1)), ("fraud", 2, 2, "Production", dt.datetime(2024, 1, 2)),
            ("fraud", 3, 3, "None", dt.datetime(2024, 1, 3))]
    return spark.createDataFrame(rows, "name string, version long, run_id long, current_stage string, "
                                       "creation_timestamp timestamp")


def test_promote_latest_and_register(spark):
    v = _versions(spark)
    got = {r.version: r.current_stage for r in R.promote_latest(v).collect()}
    assert got == {1: "None", 2: "Production", 3: "Staging"}
    nv = R.register_version(v, "fraud", 9, F.current_timestamp()).first()
    assert nv.version == 4 and nv.current_stage == "None"


def test_metric_trend_declining(spark):
    h = spark.createDataFrame([("m", i, dt.datetime(2024, 1, i + 1), f) for i, f in enumerate([0.85, 0.82, 0.79, 0.76])],
                              "name string, version long, creation_timestamp timestamp, value double")
    r = R.metric_trend(h).first()
    assert (r.latest, r.best, r.trend, r.direction) == (0.76, 0.85, "-", "DECLINING")
