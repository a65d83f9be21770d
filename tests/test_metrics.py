"""Evaluation metrics: hand goldens, numpy references, partition invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import metrics as M

# golden: 10 predictions of the reference's demo monitor
# Golden input and its expected results.
Y_TRUE = [0, 0, 1, 0, 1, 0, 0, 1, 0, 0]
Y_PRED = [0, 0, 1, 0, 0, 1, 0, 1, 0, 0]
# golden: sample prediction file of the reference's setup script
SAMPLE = [(0, 0), (1, 1), (0, 0), (1, 0), (0, 0), (1, 1), (0, 0), (0, 1), (1, 1), (0, 0)]


def _df(spark, yt, yp):
    return spark.createDataFrame(list(zip(yt, yp)), "y_true int, y_pred int")


def test_confusion_and_binary_metrics_golden(spark):
    r = M.binary_metrics(_df(spark, Y_TRUE, Y_PRED)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 6)
    assert r.accuracy == pytest.approx(0.8)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)
    assert r.f1 == pytest.approx(2 / 3)


def test_sample_predictions_golden(spark):
    df = spark.createDataFrame([(t, p) for p, t in SAMPLE], "y_true int, y_pred int")
    r = M.binary_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 1, 5)
    assert r.accuracy == pytest.approx(0.8)
    assert r.precision == pytest.approx(0.75) and r.recall == pytest.approx(0.75) and r.f1 == pytest.approx(0.75)


def test_zero_division_is_zero(spark):
    r = M.binary_metrics(_df(spark, [0, 0, 0], [0, 0, 0])).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert r.accuracy == 1.0


def test_classification_report_multiclass(spark):
    yt = [0, 1, 2, 2, 1, 0, 2]
    yp = [0, 2, 2, 2, 1, 1, 0]
    rep = {r.label: r for r in M.classification_report(_df(spark, yt, yp)).collect()}
    assert rep["2"].support == 3 and rep["2"].precision == pytest.approx(2 / 3)
    assert rep["accuracy"].f1_score == pytest.approx(4 / 7)
    # weighted F1 = sum support * f1 / n
    f1 = {c: rep[c].f1_score for c in "012"}
    sup = {c: rep[c].support for c in "012"}
    assert rep["weighted avg"].f1_score == pytest.approx(sum(f1[c] * sup[c] for c in "012") / 7)
    assert rep["macro avg"].f1_score == pytest.approx(sum(f1.values()) / 3)


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_reference(y, s):
    y, s = np.asarray(y), np.asarray(s)
    thr = np.unique(s)[::-1]
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


@pytest.mark.parametrize("partitions", [1, 17])
def test_auc_ap_tie_exact_and_partition_invariant(spark, partitions):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400).tolist()
    s = (np.floor(rng.random(400) * 20) / 20).tolist()  # heavy ties
    df = spark.createDataFrame(list(zip(y, s)), "y_true int, score double").repartition(partitions)
    r = M.score_metrics(df, "y_true", "score", buckets=5).first()
    assert r.roc_auc == pytest.approx(_auc_bruteforce(y, s), abs=1e-12)
    assert r.average_precision == pytest.approx(_ap_reference(y, s), abs=1e-12)


def test_roc_curve_points(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y_true int, score double")
    pts = {r.threshold: (r.fpr, r.tpr) for r in M.roc_curve(df, buckets=2).collect()}
    assert pts[0.9] == (0.0, 0.5)
    assert pts[0.8] == (0.5, 1.0)
    assert pts[0.1] == (1.0, 1.0)


def test_single_class_auc_is_half(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y_true int, score double")
    assert M.roc_auc(df).first().roc_auc == 0.5


def test_grouped_metrics(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 0, 1), ("B", 1, 0)], "g string, y_true int, y_pred int")
    got = {r.g: (r.tp, r.fp, r.fn) for r in M.binary_metrics(df, by=["g"]).collect()}
    assert got == {"A": (1, 1, 0), "B": (0, 0, 1)}


def test_evaluation_summary_matches_separate_metrics(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300).tolist()
    s = (np.floor(rng.random(300) * 10) / 10).tolist()
    g = ["a" if i % 3 else "b" for i in range(300)]
    df = spark.createDataFrame([(gg, yy, ss, int(ss >= 0.5)) for gg, yy, ss in zip(g, y, s)],
                               "g string, y_true int, score double, y_pred int").repartition(5)
    one = {r.g: r for r in M.evaluation_summary(df, by=["g"], buckets=4).collect()}
    sep = {r.g: r for r in M.binary_metrics(df, by=["g"]).collect()}
    auc = {r.g: r for r in M.score_metrics(df, by=["g"], buckets=4).collect()}
    for k in ("a", "b"):
        assert (one[k].tp, one[k].fp, one[k].fn, one[k].tn) == (sep[k].tp, sep[k].fp, sep[k].fn, sep[k].tn)
        assert one[k].roc_auc == pytest.approx(auc[k].roc_auc, abs=1e-12)
        assert one[k].average_precision == pytest.approx(auc[k].average_precision, abs=1e-12)
