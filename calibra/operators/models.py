"""Training, tuning and scoring with ``pyspark.ml``.

Estimators are the stock distributed ones (RandomForest, LogisticRegression,
GBT, LinearSVC); class balance is a weight column joined from the per-class
count table; tuning is cross-validation over an explicit stratified
fold column; scoring is ``model.transform`` plus column expressions.  Foreign
Python scorers run batch-wise through ``mapInPandas`` (Arrow), never per row.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.operators import trees
from calibra.operators.quality import confidence_band, risk_score

# Default hyper-parameters per model type.
DEFAULTS = {
    "random_forest": {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2},
    "logistic_regression": {"C": 0.1, "penalty": "l2", "maxIter": 2000},
    "xgboost": {"maxIter": 200, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8},
    "svm": {"C": 1.0, "maxIter": 100},
}
MODEL_TYPES = list(DEFAULTS)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M5: ``balanced`` weight n / (k * n_c) per class (one row per class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    from pyspark.sql import Window

    allw = Window.partitionBy()
    return c.select(label, "n_class",
                    (F.sum("n_class").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight; the class table is bounded by the number of classes."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label, "left")


#: model types whose C multiplies an un-averaged loss: Spark's penalty is 1 / (C n)
PENALISED = ("logistic_regression", "svm")


def row_weight(df: DataFrame, weight_col: str | None = "weight") -> int:
    """n of the penalty: the sum of the weights, or the row count without any."""
    return round((df.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0]) or 1)


def make_estimator(kind: str, label: str = "label", weight_col: str | None = "weight",
                   seed: int = 42, **params):
    """M1-M4: a pyspark.ml classifier configured like the reference model types."""
    p = {**DEFAULTS[kind], **params}
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "random_forest":
        est = RandomForestClassifier(numTrees=p["numTrees"], maxDepth=min(int(p["maxDepth"]), 30),
                                     minInstancesPerNode=p["minInstancesPerNode"], seed=seed, **common)
    elif kind == "logistic_regression":
        # sklearn C is the inverse of an un-averaged penalty; Spark averages the loss.
        est = LogisticRegression(regParam=1.0 / float(p["C"]) / max(1, int(p.get("n", 1))),
                                 elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
                                 standardization=False, maxIter=p["maxIter"], **common)
    elif kind == "xgboost":
        est = GBTClassifier(maxIter=p["maxIter"], maxDepth=p["maxDepth"], stepSize=p["stepSize"],
                            subsamplingRate=p["subsamplingRate"], seed=seed, **common)
    elif kind == "svm":
        est = LinearSVC(regParam=1.0 / float(p["C"]) / max(1, int(p.get("n", 1))), maxIter=p["maxIter"],
                        **common)
    else:
        raise ValueError(f"Unsupported model type: {kind}")
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def fit_model(df: DataFrame, features: Sequence[str], label: str, kind: str,
              weight_col: str | None = "weight", **params) -> PipelineModel:
    """Assemble features and fit one model type (weights must already be attached)."""
    if kind in PENALISED and "n" not in params:
        params["n"] = row_weight(df, weight_col)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[asm, make_estimator(kind, label, weight_col, **params)]).fit(df)


def positive_probability(pred: DataFrame) -> Column:
    """P(class 1) from a pyspark.ml prediction (raw margin -> sigmoid for LinearSVC)."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring: prediction, probability, confidence band, risk score."""
    out = model.transform(df)
    p = positive_probability(out)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), p.alias("probability")).withColumns({
        "confidence": confidence_band("probability"), "risk_score": risk_score("probability")})


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0) -> Column:
    """sigmoid(sum w x + b) as one codegen expression (a fixed, exported linear model)."""
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.col(c) * F.lit(float(w))
    return 1.0 / (1.0 + F.exp(-z))


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], tuple], cols: Sequence[str],
               keep: Sequence[str] = ()) -> DataFrame:
    """UDF surface of the monitor decorator: run a Python scorer on Arrow batches.

    ``fn(batch)`` returns predictions or ``(predictions, confidences)``;
    a missing confidence is 0.5.  Adds ``prediction``, ``confidence``,
    ``processing_time_ms`` (the batch time spread over its rows).
    """
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("prediction", T.IntegerType()),
                           T.StructField("confidence", T.DoubleType()),
                           T.StructField("processing_time_ms", T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if pdf.empty:
                continue
            t0 = time.perf_counter()
            res = fn(pdf[list(cols)])
            ms = (time.perf_counter() - t0) * 1000.0 / len(pdf)
            if isinstance(res, tuple):
                pred, conf = res[0], (res[1] if len(res) > 1 else np.full(len(pdf), 0.5))
            else:
                pred, conf = res, np.full(len(pdf), 0.5)
            out = pdf[list(keep)].copy()
            out["prediction"] = np.asarray(pred).astype("int32")
            out["confidence"] = np.asarray(conf, dtype="float64")
            out["processing_time_ms"] = ms
            yield out

    return df.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)


def margins(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the raw margin of class 1."""
    return model.transform(df).select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))


def fit_platt(scored: DataFrame, label: str, margin: str = "margin") -> tuple[float, float]:
    """(a, b) of P(class 1) = 1 / (1 + exp(-(a margin + b))), Platt's smoothed targets.

    A positive row counts as positive with (n+ + 1) / (n+ + 2), a negative one with 1 / (n- + 2):
    every row enters once per class with these weights, and the two numbers are fitted by
    an unpenalised logistic regression, which iterates over partial sums.
    """
    y = F.col(label) == 1
    pos, neg = scored.agg(F.count_if(y), F.count_if(~y)).first()
    up = F.when(y, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    rows = scored.select(margin, F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), up.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - up).alias("w")))).alias("e"))
    table = VectorAssembler(inputCols=[margin], outputCol="x").transform(rows.select(margin, "e.y", "e.w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, standardization=False,
                               maxIter=200, tol=1e-10).fit(table)
    return float(model.coefficients[0]), float(model.intercept)


def fit_calibrated_svm(df: DataFrame, features: Sequence[str], label: str, fold_col: str,
                       weight_col: str | None = "weight", **params) -> tuple[PipelineModel, tuple[float, float]]:
    """M4: a linear SVM and its probability scale, cross-fitted.

    For every fold an SVM of the other folds gives the margins of its rows, so the scale is fitted on
    margins of rows that no model has seen; the model itself is fitted on all rows.
    """
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-fitting needs at least two folds")
    parts = []
    for f in folds:
        model = fit_model(df.where(F.col(fold_col) != f), features, label, "svm", weight_col, **params)
        parts.append(margins(model, df.where(F.col(fold_col) == f), [label]))
    # the margins are read in every iteration of the fit
    out = reduce(DataFrame.unionByName, parts).persist()
    try:
        scale = fit_platt(out, label)
    finally:
        out.unpersist()
    return fit_model(df, features, label, "svm", weight_col, **params), scale


def calibrated_scores(model: PipelineModel, scale: tuple[float, float], df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M13 for a calibrated SVM: prediction at 0.5, probability, confidence band, risk score."""
    z = F.col("margin") * scale[0] + scale[1]
    p = 1.0 / (1.0 + F.exp(-z))
    return margins(model, df, keep).select(*keep, (p >= 0.5).cast("int").alias("prediction"), p.alias("probability")).withColumns({
        "confidence": confidence_band("probability"), "risk_score": risk_score("probability")})


def evaluate(pred: DataFrame, label: str) -> dict:
    """Weighted F1 and accuracy of a prediction frame, from one count by label and prediction."""
    counts = {(r[0], r[1]): r[2] for r in pred.groupBy(
        F.col(label).cast("double").alias("y"), F.col("prediction").cast("double").alias("p")).count().collect()}
    if any(v is None or v != v for pair in counts for v in pair):
        raise ValueError("labels and predictions must not be missing")
    n = sum(counts.values())
    if not n:
        return {"weighted_f1": 0.0, "accuracy": math.nan}
    hits = sum(c for (y, p), c in counts.items() if y == p)
    f1 = 0.0
    for k in sorted({y for y, _ in counts}):
        true, said = (sum(c for pair, c in counts.items() if pair[i] == k) for i in (0, 1))
        tp = counts.get((k, k), 0)
        precision, recall = tp / said if said else 0.0, tp / true
        f1 += true / n * (2 * precision * recall / (precision + recall) if tp else 0.0)
    return {"weighted_f1": f1, "accuracy": hits / n}


def _tree_estimators(kinds: Sequence[str], features: Sequence[str], label: str, params: Mapping) -> dict:
    """Estimators whose trees grow from counted rows; one that can't be made is left to its fit, which says why."""
    out = {}
    for kind in kinds:
        try:
            est = make_estimator(kind, label, **params.get(kind, {}))
        except Exception:  # noqa: BLE001 - fails again in its own fit
            continue
        if trees.grows(est, len(features)):
            out[kind] = est
    return out


def train_many(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
               kinds: Sequence[str] = MODEL_TYPES, **params) -> list[tuple]:
    """M7: fit every model type on the same stored training data; failures become rows.

    Tree models grow from rows that are counted once for all of them.
    """
    out, cells = [], {}
    ests = _tree_estimators(kinds, features, label, params)
    for kind in kinds:
        try:
            if kind in ests:
                by = trees.counted_by(ests[kind])
                if by not in cells:
                    cells[by] = trees.count_cells(train, features, label, {k: e for k, e in ests.items() if trees.counted_by(e) == by})
                model = trees.fit(cells[by], ests[kind], kind)
            else:
                model = fit_model(train, features, label, kind, **params.get(kind, {}))
            m = evaluate(model.transform(test.select(*features, label)), label)
            out.append((kind, "SUCCESS", m["weighted_f1"], m["accuracy"], None))
        except Exception as e:  # noqa: BLE001 - recorded like the reference's status table
            out.append((kind, "FAILED", None, None, str(e)[:200]))
    return out


def grid(kind: str, est, values: Mapping[str, Sequence]) -> list:
    """M8: ParamGridBuilder over the estimator's params named in ``values``."""
    b = ParamGridBuilder()
    for name, vals in values.items():
        b = b.addGrid(est.getParam(name), list(vals))
    return b.build()


def random_grid(kind: str, est, n_trials: int = 50, seed: int = 42, n: int = 1) -> list:
    """M9: seeded random search over the reference's ranges (log-uniform C).

    ``n`` is the row weight of the training data: C multiplies an un-averaged loss, so Spark's
    penalty is 1 / (C n).
    """
    rng = random.Random(seed)
    maps = []
    for _ in range(n_trials):
        if kind == "random_forest":
            maps.append({est.numTrees: rng.randint(100, 500), est.maxDepth: rng.randint(10, 30),
                         est.minInstancesPerNode: rng.randint(1, 4)})
        elif kind == "logistic_regression":
            c = 10 ** rng.uniform(-2, 2)
            maps.append({est.regParam: 1.0 / (c * max(1, n)), est.elasticNetParam: rng.choice([0.0, 1.0])})
        else:
            raise ValueError(f"random search not supported for {kind}")
    return maps


@dataclass
class Tuned:
    """Every candidate's parameters and mean F1 over the folds, and the best one fitted on all rows."""

    maps: list
    avg_metrics: list[float]
    best_model: object


def f1_of_class_1(pred: DataFrame, label: str) -> float:
    """F1 of class 1 from one count of hits, misses and false alarms."""
    said, true = F.col("prediction") == 1, F.col(label) == 1
    tp, fp, fn = pred.agg(F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)).first()
    precision, recall = tp / (tp + fp) if tp else 0.0, tp / (tp + fn) if tp else 0.0
    return 2 * precision * recall / (precision + recall) if tp else 0.0


def tune(train: DataFrame, features: Sequence[str], label: str, kind: str, param_maps: list | None = None,
         fold_col: str = "fold", parallelism: int = 2, values: Mapping[str, Sequence] | None = None, est=None) -> Tuned:
    """M8/M9: cross-validation on a stratified fold column, scored by the F1 of class 1.

    ``param_maps`` belong to ``est``, the estimator that they were made for.  ``train`` is read by every
    fit, so it should be a stored table.  Folds are filters on its column: ``CrossValidator`` would run
    a Python function on every row of it and keep two copies of the rows per fold.
    """
    if est is None:
        est = make_estimator(kind, label, **({"n": row_weight(train)} if kind in PENALISED else {}))
    maps = param_maps if param_maps is not None else grid(kind, est, values or {})
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    found = [r[0] for r in train.select(fold_col).distinct().collect()]
    if any(f is None or f < 0 for f in found):
        raise ValueError("folds are numbered from 0")
    folds = range(max(found, default=-1) + 1)
    if len(found) < max(2, len(folds)):
        raise ValueError(f"folds must be two or more and hold rows, found {sorted(found)}")
    assembled = asm.transform(train).select("features", label, fold_col, "weight")

    def run(task: tuple) -> float:
        fold, params = task
        model = est.fit(assembled.where(F.col(fold_col) != fold), params)
        return f1_of_class_1(model.transform(assembled.where(F.col(fold_col) == fold)), label)

    pool = ThreadPool(parallelism)
    try:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(run), [(f, m) for f in folds for m in maps])
    finally:
        pool.close()
    averages = [float(np.mean(scores[i::len(maps)])) for i in range(len(maps))]
    return Tuned(maps, averages, est.fit(assembled, maps[int(np.argmax(averages))]))


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, or |coefficient| for linear models, descending."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray()
    else:
        vals = np.abs(m.coefficients.toArray())
    return sorted(zip(features, map(float, vals)), key=lambda x: (-x[1], x[0]))


def train_and_evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                       kind: str = "random_forest", **params) -> dict:
    """M6: fit on train, evaluate on test: weighted F1, accuracy, AUC and detection counts."""
    from calibra.operators import metrics as M

    model = fit_model(train, features, label, kind, **params)
    scored = score(model, test, keep=[label])
    cm = M.binary_metrics(scored, label, "prediction").first()
    auc = M.roc_auc(scored, label, "probability").first()["roc_auc"]
    return {"model": model, "weighted_f1": evaluate(model.transform(test), label)["weighted_f1"],
            "accuracy": cm["accuracy"], "precision": cm["precision"], "recall": cm["recall"], "f1": cm["f1"],
            "roc_auc": auc, "fraud_detected": f"{cm['tp']}/{cm['tp'] + cm['fn']}"}


def metadata_record(spark, run_id: int, name: str, kind: str, n_samples: int, fraud_ratio: float,
                    metrics: Mapping[str, float], created=None) -> DataFrame:
    """A run-log row describing a trained model (append with ``runs.record_runs``)."""
    created = created if created is not None else F.current_timestamp()
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), F.lit(float(v)))])
    p = F.create_map(F.lit("model_name"), F.lit(name), F.lit("model_type"), F.lit(kind),
                     F.lit("n_samples"), F.lit(str(n_samples)), F.lit("fraud_ratio"), F.lit(str(fraud_ratio)))
    return spark.range(1).select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit("training").alias("experiment"),
                                 created.alias("start_time"), m.alias("metrics"), p.alias("params"))
