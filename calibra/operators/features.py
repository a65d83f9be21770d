"""Feature scaling and PCA (F1-F8) as ``pyspark.ml`` Estimators / Models.

Fitting is one aggregation pass; the fitted parameters (d means/stds, a d x d
covariance) are tiny and enter ``transform`` as literals, so transform is a
plain projection inside whole-stage codegen.  Exact quantiles for the robust
scaler come from distributed ranks, not from collecting a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.columns import missing
from calibra.functions.selection import order_statistics
from calibra.operators.quality import _is_missing


def assert_no_missing(df: DataFrame, cols: Sequence[str] | None = None) -> None:
    """Raise ``ValueError`` when any column holds NULL/NaN (F1 fit rule: all columns)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in cols]).first()
    raise_missing({c: row[c] for c in cols})


def raise_missing(counts: dict) -> None:
    bad = [c for c, n in counts.items() if n]
    if bad:
        raise ValueError(f"Input contains NaN values in columns: {bad}")


class _ScalerParams(HasInputCols):
    excludeCols = Param(Params._dummy(), "excludeCols", "columns passed through unscaled",
                        typeConverter=TypeConverters.toListString)
    centers = Param(Params._dummy(), "centers", "fitted centres", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted divisors", typeConverter=TypeConverters.toListFloat)


class PopulationStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / std with the *population* std; zero variance -> divisor 1.

    ``pyspark.ml.feature.StandardScaler`` uses the sample std, hence this class.
    Any NULL/NaN in the frame (excluded columns too) raises ``ValueError``.
    """

    def __init__(self, inputCols: Sequence[str] | None = None, excludeCols: Sequence[str] = ()):
        super().__init__()
        self._setDefault(excludeCols=[])
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        self._set(excludeCols=list(excludeCols))

    def _fit(self, df: DataFrame) -> PopulationStandardScalerModel:
        excl = set(self.getOrDefault("excludeCols"))
        cols = [c for c in (self.getOrDefault("inputCols") if self.isDefined("inputCols") else df.columns)
                if c not in excl]
        # one pass: missing values of all columns, means and deviations of the scaled ones
        row = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"n_{c}") for c in df.columns],
                     *[F.avg(c).alias(f"m_{c}") for c in cols],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        raise_missing({c: row[f"n_{c}"] for c in df.columns})
        means = [float(row[f"m_{c}"]) for c in cols]
        stds = [float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0 for c in cols]
        m = PopulationStandardScalerModel()
        m._set(inputCols=cols, centers=means, scales=stds, excludeCols=list(excl))
        return m


class PopulationStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("inputCols")
        c, s = self.getOrDefault("centers"), self.getOrDefault("scales")
        repl = {col: (F.col(col) - F.lit(mu)) / F.lit(sd) for col, mu, sd in zip(cols, c, s)}
        return df.withColumns(repl)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(feature, prob, value)``: exact linear-interpolated quantiles (R-7 rule).

    The order statistics are found by narrowing intervals over the scan
    (:func:`calibra.functions.selection.order_statistics`): no value is shuffled or
    persisted, only counts of cells.  A feature without values has no row.
    """
    found, _ = order_statistics(df, {c: [float(p) for p in probs] for c in cols})
    rows = [(c, p, lower + (upper - lower) * fraction) for c, by in found.items() for p, (lower, upper, fraction) in by.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, value double")


class RobustScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / (q75 - q25) with exact interpolated quantiles; IQR 0 -> 1.

    Missing values are an error, excluded columns stay as they are.
    """

    def __init__(self, inputCols: Sequence[str] | None = None, excludeCols: Sequence[str] = ()):
        super().__init__()
        self._setDefault(excludeCols=[])
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        if excludeCols:
            self._set(excludeCols=list(excludeCols))

    def _fit(self, df: DataFrame) -> PopulationStandardScalerModel:
        excl = self.getOrDefault("excludeCols")
        cols = [c for c in self.getOrDefault("inputCols") if c not in excl]
        # the pass that counts the values counts the missing ones too
        found, missing_values = order_statistics(df, dict.fromkeys(cols, (0.25, 0.5, 0.75)))
        raise_missing(missing_values)
        q = {c: {p: lower + (upper - lower) * f for p, (lower, upper, f) in by.items()} for c, by in found.items()}
        med = [float(q[c][0.5]) for c in cols]
        iqr = [float(q[c][0.75] - q[c][0.25]) or 1.0 for c in cols]
        m = PopulationStandardScalerModel()
        m._set(inputCols=list(cols), centers=med, scales=iqr, excludeCols=list(excl))
        return m


def covariance_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """population covariance matrix as ``(feature_i, feature_j, covariance)``, one pass."""
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.covar_pop(a, b).alias(f"{a}|{b}"))
    wide = df.agg(*aggs)
    names = [f"{a}|{b}" for i, a in enumerate(cols) for b in cols[i:]]
    long = wide.unpivot([], names, "_pair", "covariance")
    a, b = F.split("_pair", r"\|").getItem(0), F.split("_pair", r"\|").getItem(1)
    upper = long.select(a.alias("feature_i"), b.alias("feature_j"), "covariance")
    lower = upper.where(F.col("feature_i") != F.col("feature_j")).select(
        F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "covariance")
    return upper.unionByName(lower)


def block_moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariance) of numeric columns, or of one array column.

    Every task multiplies its Arrow batches as numpy blocks and keeps one d x d sum; the tasks'
    sums are added up cell by cell in Spark, and d + d x d numbers reach the driver.
    Values are shifted by the first row, so large means do not swallow small variances.
    """
    array = len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array"
    x = F.col(cols[0]).cast("array<double>") if array else F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select(x.alias("x"))
    one = rows.first()
    if one is None:
        return 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    shift = np.nan_to_num(np.array([v if v is not None else 0.0 for v in one[0]], dtype=np.float64))
    d = len(shift)

    def work(batches):
        n, total, gram = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != b.num_rows * d:
                raise ValueError(f"every row needs {d} values")
            for lo in range(0, b.num_rows, 4096):
                block = flat[lo * d:(lo + 4096) * d].reshape(-1, d) - shift
                n, total, gram = n + len(block), total + block.sum(0), gram + block.T @ block
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.append(total, gram.ravel()).tolist()])],
                                             names=["n", "sums"])

    parts = rows.mapInArrow(work, "n long, sums array<double>")
    sums = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    n, flat = sums[0]["n"], np.zeros(d + d * d)
    for r in sums:
        flat[r["i"]] = r["s"]
    mean = flat[:d] / n
    return n, mean + shift, flat[d:].reshape(d, d) / n - np.outer(mean, mean)


def block_covariance(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``feature_i, feature_j, covariance`` from :func:`block_moments`."""
    _, _, cov = block_moments(df, cols)
    names = list(names or (cols if len(cov) == len(cols) else [f"{cols[0]}_{i}" for i in range(len(cov))]))
    return df.sparkSession.createDataFrame(
        [(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)],
        "feature_i string, feature_j string, covariance double")


class _PCAParams(HasInputCols):
    k = Param(Params._dummy(), "k", "number of components (0 = by variance threshold)",
              typeConverter=TypeConverters.toInt)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "cumulative explained variance",
                              typeConverter=TypeConverters.toFloat)
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    components = Param(Params._dummy(), "components", "row-major k x d loadings",
                       typeConverter=TypeConverters.toListFloat)
    explained = Param(Params._dummy(), "explained", "explained variance ratio of all d components",
                      typeConverter=TypeConverters.toListFloat)


class CenteredPCA(Estimator, _PCAParams, DefaultParamsReadable, DefaultParamsWritable):
    """PCA on centred data (``pyspark.ml.feature.PCA`` does not centre).

    One pass of block products builds the d x d covariance (missing values are an
    error); the eigen-decomposition of that small matrix runs on the driver.  Sign rule: the largest-|loading| entry
    of every component is positive.  ``k=0`` picks the smallest k whose
    cumulative ratio reaches ``varianceThreshold`` (all d if none does).
    """

    def __init__(self, inputCols: Sequence[str] | None = None, k: int = 0, varianceThreshold: float = 0.95):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        self._set(k=k, varianceThreshold=varianceThreshold)

    def _fit(self, df: DataFrame) -> CenteredPCAModel:
        cols = list(self.getOrDefault("inputCols"))
        d = len(cols)
        n, means, cov = block_moments(df, cols)
        if not n:
            raise ValueError("PCA needs at least one row")
        raise_missing({c: int(np.isnan(m)) for c, m in zip(cols, means, strict=True)})
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1]
        vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
        for j in range(d):
            if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
                vecs[:, j] = -vecs[:, j]
        total = vals.sum()
        ratio = vals / total if total > 0 else np.zeros(d)
        k = self.getOrDefault("k")
        if not k:
            cum = np.cumsum(ratio)
            hit = np.nonzero(cum >= self.getOrDefault("varianceThreshold") - 1e-12)[0]
            k = int(hit[0]) + 1 if hit.size else d
        m = CenteredPCAModel()
        m._set(inputCols=cols, k=int(k), means=[float(m) for m in means],
               components=[float(x) for x in vecs[:, :k].T.ravel()], explained=[float(x) for x in ratio])
        return m


class CenteredPCAModel(Model, _PCAParams, DefaultParamsReadable, DefaultParamsWritable):
    def _loadings(self) -> np.ndarray:
        d = len(self.getOrDefault("inputCols"))
        return np.array(self.getOrDefault("components")).reshape(self.getOrDefault("k"), d)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, means = self.getOrDefault("inputCols"), self.getOrDefault("means")
        load = self._loadings()
        pcs = []
        for i in range(load.shape[0]):
            e = None
            for c, mu, w in zip(cols, means, load[i]):
                t = (F.col(c) - F.lit(mu)) * F.lit(float(w))
                e = t if e is None else e + t
            pcs.append(e.alias(f"PC{i + 1}"))
        return df.select(*[c for c in df.columns if c not in cols], *pcs)

    def explained_variance(self, spark) -> DataFrame:
        """``(component, ratio, cum_ratio)`` for every component."""
        r = self.getOrDefault("explained")
        cum = np.cumsum(r)
        return spark.createDataFrame([(f"PC{i + 1}", float(r[i]), float(cum[i])) for i in range(len(r))],
                                     "component string, ratio double, cum_ratio double")

    def loadings(self, spark, component: int | None = None) -> DataFrame:
        """``(component, feature, loading, importance=|loading|)`` sorted by importance."""
        load = self._loadings()
        if component is not None and not 1 <= component <= load.shape[0]:
            raise ValueError(f"Component {component} out of range 1..{load.shape[0]}")
        rows = [(f"PC{i + 1}", c, float(load[i, j]), float(abs(load[i, j])))
                for i in range(load.shape[0]) if component in (None, i + 1)
                for j, c in enumerate(self.getOrDefault("inputCols"))]
        df = spark.createDataFrame(rows, "component string, feature string, loading double, importance double")
        return df.orderBy("component", F.desc("importance"), "feature")


def feature_chain(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], label: str,
                  id_col: str | None = None, pca_k: int | None = None, resample: str | None = "smote",
                  k_neighbors: int = 5):
    """F8: scale -> optional PCA -> optional oversampling of the training part only.

    The scaler and PCA are fitted on ``train`` and applied to every frame in
    ``others`` (validation, test).  Oversampling (``"smote"``) needs an
    ``id_col`` and works on an array column of the transformed features.
    Returns ``(train_out, [others_out...], fitted_models)``.
    """
    from calibra.operators.neighbors import smote

    scaler = PopulationStandardScaler(list(cols)).fit(train.select(*cols))
    fitted = [scaler]
    tr, rest = scaler.transform(train), [scaler.transform(o) for o in others]
    out_cols = list(cols)
    if pca_k:
        pca = CenteredPCA(list(cols), k=pca_k).fit(tr.select(*cols))
        fitted.append(pca)
        tr, rest = pca.transform(tr), [pca.transform(o) for o in rest]
        out_cols = [f"PC{i + 1}" for i in range(pca_k)]
    if resample == "smote":
        if id_col is None:
            raise ValueError("oversampling needs an id column")
        arr = tr.select(id_col, label, F.array(*[F.col(c).cast("double") for c in out_cols]).alias("features"))
        tr = smote(arr, label, id_col, "features", k=k_neighbors)
    return tr, rest, fitted
