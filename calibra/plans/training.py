"""Queries for class weights, scoring, training and tuning (M*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from calibra.llm.scratch import stored
from calibra.operators import features as FE
from calibra.operators import models as ML
from calibra.operators import sampling as S
from calibra.operators.quality import confidence_band
from calibra.plans.registry import query
from calibra.plans.sqlviews import with_views
from calibra.sources import views as V

# An exported linear fraud scorer used for batch scoring checks.
LINEAR_WEIGHTS = {"l_quantity": 0.04, "l_extendedprice": 0.00001, "l_discount": -8.0, "l_tax": 6.0}
LINEAR_INTERCEPT = -1.5
# Small, fast settings for the registered training queries.
QUICK = {"random_forest": {"numTrees": 20, "maxDepth": 5}, "xgboost": {"maxIter": 10, "maxDepth": 3},
         "logistic_regression": {"maxIter": 50}, "svm": {"maxIter": 20}}


@query("class_weights",
       sql=with_views("tx") + """
, c AS (SELECT Class, count(*) AS n_class FROM tx GROUP BY Class)
SELECT Class, n_class, sum(n_class) OVER () / (count(*) OVER () * n_class) AS weight FROM c""",
       rounded="weight")
def class_weights(spark, sf_dir):
    """M5: balanced class weights n / (k n_c)."""
    return ML.class_weights(V.tx(spark, sf_dir), "Class")


_Z_SQL = " + ".join([repr(LINEAR_INTERCEPT)] + [f"{c} * {w!r}" for c, w in LINEAR_WEIGHTS.items()])


@query("batch_scoring",
       sql=with_views("tx") + f"""
, s AS (SELECT {', '.join(V.TX_KEY)}, 1.0 / (1.0 + exp(-({_Z_SQL}))) AS probability FROM tx)
SELECT {', '.join(V.TX_KEY)}, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction,
       CASE WHEN probability < 0.3 THEN 'low' WHEN probability < 0.7 THEN 'medium' ELSE 'high' END AS confidence,
       probability * 100.0 AS risk_score
FROM s""",
       rounded="probability risk_score")
def batch_scoring(spark, sf_dir):
    """Vectorised batch scoring with a fixed linear model (one codegen projection)."""
    t = V.tx(spark, sf_dir)
    p = ML.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    s = t.select(*V.TX_KEY, p.alias("probability"))
    return s.select(*V.TX_KEY, "probability", (F.col("probability") >= 0.5).cast("int").alias("prediction"),
                    confidence_band("probability").alias("confidence"),
                    (F.col("probability") * 100.0).alias("risk_score"))


def _split(spark, sf_dir, k=0):
    """Stratified split, scaler fitted on train only (F8), balanced weights and ``k`` folds on train.

    Training reads its rows many times.  Rows with their hashes are written once, so no pass
    works them out again; the finished training rows, too, so a fit reads plain columns.
    """
    hashes = {"_split": S.row_u32(V.TX_KEY, "split42")} | ({"_fold": S.row_u32(V.TX_KEY, "fold42")} if k else {})
    t = stored(V.tx(spark, sf_dir).select(*V.TX_KEY, *V.TX_FEATURES, "Class").withColumns(hashes), "transactions")
    s = S.stratified_split(t, "Class", V.TX_KEY, 0.2, "split42", u="_split")
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    scaler = FE.PopulationStandardScaler(V.TX_FEATURES).fit(train.select(*V.TX_FEATURES, "Class"))
    fold = []
    if k:
        train, fold = S.fold_assignment(train, "Class", V.TX_KEY, k, "fold42", u="_fold"), ["fold"]
    train = ML.with_class_weights(scaler.transform(train), "Class").select(*V.TX_FEATURES, "Class", "weight", *fold)
    return stored(train, "train"), scaler.transform(test)


@query("train_models")
def train_models(spark, sf_dir):
    """M1-M4, M7: every model type trained on the stratified train split, scored on test."""
    train, test = _split(spark, sf_dir)
    rows = ML.train_many(train, test, V.TX_FEATURES, "Class", **QUICK)
    return spark.createDataFrame(rows, "model string, status string, weighted_f1 double, accuracy double, "
                                       "error string")


@query("model_scoring")
def model_scoring(spark, sf_dir):
    """Logistic regression fitted on train, scored on every test row."""
    train, test = _split(spark, sf_dir)
    model = ML.fit_model(train, V.TX_FEATURES, "Class", "logistic_regression", **QUICK["logistic_regression"])
    return ML.score(model, test, keep=[*V.TX_KEY, "Class"])


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Random-forest importances of the transaction features."""
    train, _ = _split(spark, sf_dir)
    model = ML.fit_model(train, V.TX_FEATURES, "Class", "random_forest", **QUICK["random_forest"])
    return spark.createDataFrame(ML.feature_importance(model, V.TX_FEATURES), "feature string, importance double")


@query("cv_tuning")
def cv_tuning(spark, sf_dir):
    """5-fold grid search (stratified fold column) scored by the F1 of class 1."""
    folds, _ = _split(spark, sf_dir, 5)
    n = ML.row_weight(folds)
    est = ML.make_estimator("logistic_regression", "Class", n=n, maxIter=20)
    found = ML.tune(folds, V.TX_FEATURES, "Class", "logistic_regression", est=est,
                    values={"regParam": [1.0 / (c * n) for c in (0.1, 1.0)], "elasticNetParam": [0.0, 1.0]})
    return _searched(spark, est, found, n)


def _searched(spark, est, found, n):
    rows = [(1.0 / (float(m[est.regParam]) * n), "l1" if m[est.elasticNetParam] else "l2", float(s))
            for m, s in zip(found.maps, found.avg_metrics, strict=True)]
    return spark.createDataFrame(rows, "C double, penalty string, f1_class1 double")


@query("random_search")
def random_search(spark, sf_dir):
    """M9: sampled search over C and the penalty, 5 stratified folds, F1 of class 1."""
    folds, _ = _split(spark, sf_dir, 5)
    n = ML.row_weight(folds)
    est = ML.make_estimator("logistic_regression", "Class", n=n, maxIter=20)
    found = ML.tune(folds, V.TX_FEATURES, "Class", "logistic_regression", est=est,
                    param_maps=ML.random_grid("logistic_regression", est, 3, n=n))
    return _searched(spark, est, found, n)


@query("svm_probability")
def svm_probability(spark, sf_dir):
    """M4: calibrated probabilities of a linear SVM for every test row."""
    folds, test = _split(spark, sf_dir, 3)
    model, scale = ML.fit_calibrated_svm(folds, V.TX_FEATURES, "Class", "fold", **QUICK["svm"])
    return ML.calibrated_scores(model, scale, test, keep=[*V.TX_KEY, "Class"])


def _python_scorer(batch):
    """A foreign (non-Spark) scorer: numpy on the whole Arrow batch."""
    z = LINEAR_INTERCEPT + sum(batch[c].to_numpy() * w for c, w in LINEAR_WEIGHTS.items())
    p = 1.0 / (1.0 + np.exp(-z))
    return (p >= 0.5).astype(int), p


@query("python_scoring")
def python_scoring(spark, sf_dir):
    """UDF surface: a Python scorer over Arrow batches with per-row timing."""
    t = V.tx(spark, sf_dir)
    return ML.score_with(t, _python_scorer, V.TX_FEATURES, keep=V.TX_KEY)
