"""Data quality, request handling and scoring rules."""

import math

import pytest
from pyspark.sql import functions as F

from calibra.operators import quality as Q


def test_missing_profile_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r.column_name: r.missing_count for r in Q.missing_profile(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_duplicate_rows_nan_equal(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (float("nan"), 2), (float("nan"), 2), (3.0, 3)],
                               "x double, c int")
    r = Q.duplicate_rows(df).first()
    assert r.duplicates == 2 and r.duplicate_groups == 2


def test_validation_summary_messages(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (None, 1)], "V1 double, Class int")
    r = Q.validation_summary(df, required=["V1", "Class"], target="Class").first()
    assert r.is_valid and r.rows == 3 and r.total_missing == 1 and r.duplicates == 1
    assert r.issues == ["Found 1 missing values", "Found 1 duplicate rows"]
    bad = Q.validation_summary(df, required=["Time", "V1"]).first()
    assert not bad.is_valid and bad.issues == ["Missing required columns: ['Time']"]
    empty = Q.validation_summary(df.limit(0), required=["V1"]).first()
    assert not empty.is_valid and empty.issues == ["DataFrame is empty"]


def test_confidence_bands_both_boundary_rules(spark):
    df = spark.createDataFrame([(0.8,), (0.1,), (0.3,), (0.7,)], "p double")
    out = df.select("p", Q.confidence_band("p").alias("api"), Q.confidence_band("p", closed="right").alias("svc"),
                    Q.risk_score("p").alias("risk")).collect()
    got = {r.p: (r.api, r.svc, r.risk) for r in out}
    assert got[0.8][0] == "high" and got[0.8][2] == pytest.approx(80.0)
    assert got[0.1][0] == "low" and got[0.1][2] == pytest.approx(10.0)
    assert got[0.3][:2] == ("medium", "low")
    assert got[0.7][:2] == ("high", "medium")


def test_partial_request_filled_with_zero(spark):
    req = spark.createDataFrame([({"V1": 1.5, "V2": -0.5, "Amount": 100.0},)], "features map<string,double>")
    order = ["V1", "V2", "V3", "Amount"]
    r = req.select(*Q.fill_features("features", order), Q.missing_features("features", order).alias("miss")).first()
    assert (r.V1, r.V2, r.V3, r.Amount) == (1.5, -0.5, 0.0, 100.0)
    assert r.miss == ["V3"]


def test_class_distribution(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "Class int")
    got = {r.label: (r.n, r.ratio) for r in Q.class_distribution(df, "Class").collect()}
    assert got == {0: (3, 0.75), 1: (1, 0.25)}


def test_drop_if_present_and_numeric_columns(spark):
    df = spark.createDataFrame([(1.0, 2, "x")], "Time double, Class int, s string")
    assert Q.drop_if_present(df, "Time", "nope").columns == ["Class", "s"]
    assert Q.numeric_columns(df, exclude=["Class"]) == ["Time"]
