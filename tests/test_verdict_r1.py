"""Faults on inputs that the test tables do not hold: header order, missing scores."""

import pytest
from calibra.operators import metrics
from calibra.sources import files
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("prediction", T.IntegerType()), T.StructField("true_label", T.IntegerType())])


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("true_label,extra,prediction\n1,x,0\n")
    assert [tuple(r) for r in files.load_csv(spark, str(tmp_path / "p.csv"), SCHEMA).collect()] == [(0, 1)]
    (tmp_path / "q.csv").write_text("true_label\n1\n")
    with pytest.raises(ValueError):
        files.load_csv(spark, str(tmp_path / "q.csv"), SCHEMA).collect()


def test_rows_without_a_score_count(spark):
    df = spark.createDataFrame([("A", 1, 1, 0.9), ("A", 0, 0, 0.1), ("A", 1, 0, None), ("A", 1, 1, float("nan")),
                                ("B", 1, 1, None), ("B", 0, 1, None)], "arm string, y_true int, y_pred int, score double")
    got = {r["arm"]: r for r in metrics.evaluation_summary(df, by=["arm"]).collect()}
    assert (got["A"]["n"], got["A"]["tp"], got["A"]["fn"], got["A"]["roc_auc"]) == (4, 2, 1, 1.0)
    assert (got["B"]["n"], got["B"]["accuracy"], got["B"]["roc_auc"]) == (2, 0.5, 0.5)

