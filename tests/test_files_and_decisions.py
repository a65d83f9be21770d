"""File sources/sinks, request decoding, logging rows and decision presets."""

import json

import pytest
from pyspark.sql import functions as F

from calibra.operators import abtest as AB
from calibra.operators import monitor as MON
from calibra.operators import quality as Q
from calibra.operators import runs as R
from calibra.sources import files as FS


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FS.load_csv(spark, str(tmp_path / "nope.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(FS.TX_COLUMNS) + "\n")
    with pytest.raises(FS.EmptyDataError):
        FS.load_csv(spark, str(empty))
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(FS.TX_COLUMNS) + "\n" + ",".join(["x"] * 31) + "\n")
    with pytest.raises(ValueError, match="Invalid file format"):
        FS.load_csv(spark, str(bad)).collect()


def test_csv_roundtrip_and_legacy_validation(spark, tmp_path):
    row = ",".join(["1.0"] * 30 + ["1"])
    p = tmp_path / "tx.csv"
    p.write_text(",".join(FS.TX_COLUMNS) + "\n" + row + "\n" + row + "\n")
    df = FS.load_csv(spark, str(p))
    assert df.count() == 2 and df.schema["Class"].dataType.simpleString() == "int"
    r = Q.validate_legacy(df).first()
    assert r.is_valid and r.duplicates == 1
    with pytest.raises(ValueError):
        Q.validate_step(df.drop("Time"), required=FS.TX_COLUMNS, on_invalid="raise")


def test_jsonl_append_and_read(spark, tmp_path):
    out = str(tmp_path / "log")
    ev = spark.createDataFrame([("2025-11-23T10:00:00", 1, 0.9, 0.0), ("2025-11-24T11:00:00", 0, 0.2, 1.5)],
                               FS.PREDICTION_LOG_SCHEMA)
    FS.append_jsonl(ev, out)
    FS.append_jsonl(ev, out)
    back = FS.read_jsonl(spark, out)
    assert back.count() == 4
    daily = {str(r.day): (r.predictions, r.positives) for r in MON.daily_predictions(back).collect()}
    assert daily == {"2025-11-23": (2, 2), "2025-11-24": (2, 0)}


def test_decode_single_and_batch_requests(spark):
    raw = spark.createDataFrame([(json.dumps({"V1": 1.0, "Amount": 5.0}),),
                                 (json.dumps([{"V1": 2.0}, {"V2": 3.0}]),)], "body string")
    got = FS.decode_requests(raw).select("transaction_id", *Q.fill_features("features", ["V1", "V2", "Amount"]))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1.0, 0.0, 5.0), (0, 2.0, 0.0, 0.0), (1, 0.0, 3.0, 0.0)]


def test_result_log_splits_non_finite(spark):
    one = spark.createDataFrame([(0.8, float("nan"), float("inf"), "B")], "f1 double, p double, t double, winner string")
    r = AB.result_log(one, ["f1", "p", "t"], ["winner"]).first()
    assert r.metrics == {"f1": 0.8}
    assert r.params["p"].lower() == "nan" and r.params["winner"] == "B" and "t" in r.params


def test_cli_rule_and_notifications(spark):
    d = spark.createDataFrame([(0.82, 0.85, False), (0.9, 0.85, False)], "cur double, base double, drift boolean")
    rows = d.select(*MON.cli_retrain_rule(F.col("cur"), F.col("base"), F.col("drift"))).collect()
    assert [r.action for r in rows] == ["RETRAIN", "NO ACTION"]
    dec = spark.createDataFrame([(True, ["x"]), (False, [])], "should_retrain boolean, retraining_reasons array<string>")
    notes = MON.notification_rows(dec).collect()
    assert notes[0].type == "retraining_triggered" and notes[1].type == "retraining_not_needed"
    assert notes[0].channels == ["log"]


def test_record_runs_partitioned(spark, tmp_path):
    runs = spark.createDataFrame([(1, "training"), (2, "monitoring")], "run_id long, experiment string")
    R.record_runs(runs, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs")).where("experiment = 'training'")
    assert [r.run_id for r in back.collect()] == [1]
