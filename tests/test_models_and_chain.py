"""Model training helpers, the feature chain and cluster settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import features as FE
from calibra.operators import models as ML
from calibra.session import cluster_settings


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=n)) > 1.0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, f3 double, Class int")


def test_feature_chain_fits_on_train_only_and_balances(spark, data):
    train, test = data.where("id % 5 <> 0"), data.where("id % 5 = 0")
    tr, (te,), fitted = FE.feature_chain(train, [test], ["f1", "f2", "f3"], "Class", id_col="id", pca_k=2)
    scaler = fitted[0]
    tr_means = train.agg(*[F.avg(c) for c in ("f1", "f2", "f3")]).first()
    assert np.allclose(scaler.getOrDefault("centers"), list(tr_means))
    assert te.columns[-2:] == ["PC1", "PC2"] and te.count() == test.count()
    counts = {r.Class: r["count"] for r in tr.groupBy("Class").count().collect()}
    assert counts[0] == counts[1]


def test_train_and_evaluate_and_metadata(spark, data):
    w = ML.with_class_weights(data, "Class")
    res = ML.train_and_evaluate(w, data, ["f1", "f2", "f3"], "Class", "logistic_regression", maxIter=50)
    assert 0.5 < res["roc_auc"] <= 1.0 and 0 <= res["f1"] <= 1
    tp, actual = map(int, res["fraud_detected"].split("/"))
    assert actual == data.where("Class = 1").count() and 0 <= tp <= actual
    rec = ML.metadata_record(spark, 7, "fraud", "logistic_regression", 600, 0.2, {"f1": res["f1"]}).first()
    assert rec.run_id == 7 and rec.experiment == "training" and rec.params["model_type"] == "logistic_regression"


def test_feature_importance_sorted(spark, data):
    w = ML.with_class_weights(data, "Class")
    m = ML.fit_model(w, ["f1", "f2", "f3"], "Class", "random_forest", numTrees=10, maxDepth=4)
    imp = ML.feature_importance(m, ["f1", "f2", "f3"])
    assert [v for _, v in imp] == sorted((v for _, v in imp), reverse=True)
    assert imp[0][0] == "f1"


def test_cluster_settings_scale_with_input():
    small = cluster_settings(1 << 30, 64)
    big = cluster_settings(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 64
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
