"""Forests and boosted trees from counts of binned rows (M1, M2).

A histogram tree sees of a row only the bin of each feature, its label and its weight.  Rows that
agree in these are counted in one pass over the scan, together with how often every tree draws
them, and the levels of all trees are grown over these counts: no pass of a level reads the rows
and nothing is kept in the executors' heaps.  There are at most ``bins ** features`` cells per
label and weight, whatever the number of rows, and never more than rows.

The trees are those of ``RandomForestClassifier`` and ``GBTClassifier`` on the same stored rows: split
candidates, drawn rows, features that a node looks at, gains, leaf values and losses are theirs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.columns import missing
from calibra.llm.scratch import stored

#: rows from which split candidates are taken, at least (as in pyspark.ml)
CANDIDATE_ROWS = 10_000
#: bins of a feature, at most (the default of pyspark.ml)
BINS = 32
#: numbers that the histograms of one level may hold
LEVEL_NUMBERS = 1 << 22
#: trees whose draws one row of counts may hold
DRAWS = 64
EPSILON = 2.0 ** -52


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2 i + 1 and 2 i + 2; a leaf's feature is -1."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, width: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros((n, width)))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row (a row of bins) ends."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, f] > self.split[at]))
        return at


@dataclass
class TreeModel:
    """Trees over ``features``; ``transform`` adds the prediction of every row.

    The leaves hold class shares, or with ``margin`` one number, whose sum is above 0 for class 1.
    """

    features: list[str]
    thresholds: list[np.ndarray]
    margin: bool
    trees: list[Tree] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(t, values[:, k]) for k, t in enumerate(self.thresholds)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """The weighted sum of the trees' leaf values."""
        out = 0.0
        for tree, rate in zip(self.trees, self.rates, strict=True):
            out = out + rate * tree.value[tree.node(bins)]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        raw = self.raw(bins)
        return (raw[:, 0] > 0 if self.margin else raw.argmax(1)).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.features])
                if np.isnan(x).any():
                    raise ValueError("features hold missing values")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.predict(self.bins(x)))], names=[*b.schema.names, "prediction"])

        return df.mapInArrow(run, schema)


def _candidates(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Thresholds of one feature from sampled values: ``most`` of about equal weight, or one between any two values.

    Zeros are not counted but taken to be what is missing of the ``expected`` weight (as in pyspark.ml).
    """
    kept = values != 0
    x, inverse = np.unique(values[kept], return_inverse=True)
    w = np.bincount(inverse, weights[kept], len(x))
    if len(x) and expected - w.sum() > EPSILON * kept.sum() * 100:
        at = np.searchsorted(x, 0.0)
        x, w = np.insert(x, at, 0.0), np.insert(w, at, expected - w.sum())
    middles = (x[:-1] + x[1:]) / 2.0
    if len(middles) <= most:
        return np.unique(middles)
    stride = expected / (most + 1)
    target, sums, found = stride, np.cumsum(w), []
    for k, middle in enumerate(middles):
        if abs(sums[k] - target) < abs(sums[k + 1] - target):
            found.append(middle)
            target += stride
    return np.unique(found)


def _thresholds(df: DataFrame, features: Sequence[str], weight: Column, n: int, total: float, seed: int) -> list[np.ndarray]:
    spark = df.sparkSession
    fraction = min(1.0, max(BINS * BINS, CANDIDATE_ROWS) / n)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], weight.alias("w"))
    if fraction < 1.0:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        taken = rows._jdf.javaRDD().sample(False, fraction, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(taken, rows._jdf.schema()), spark)
    x = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(features) + 1)
    return [_candidates(x[:, k], x[:, -1], fraction * total, min(BINS, n) - 1) for k in range(len(features))]


def _drawn(df: DataFrame, est: RandomForestClassifier) -> DataFrame:
    """``df`` as ``datum`` and, in ``subsampleCounts``, how often each tree of the forest draws the row.

    SQL has no function for these draws, so ``pyspark.ml``'s own step makes them; its points are
    handed to SQL by an encoder, as no Python object can.
    """
    spark = df.sparkSession
    jvm, package = spark._jvm, "org.apache.spark.sql.catalyst.encoders"
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    bagging, encoders = jvm.org.apache.spark.ml.tree.impl.BaggedPoint, jvm.org.apache.spark.sql.catalyst.encoders
    points = bagging.convertToBaggedRDD(df._jdf.rdd(), est.getSubsamplingRate(), est.getNumTrees(), est.getBootstrap(),
                                        getattr(bagging, "convertToBaggedRDD$default$5")(), est.getSeed())
    whole = jvm.java.lang.Class.forName(f"{package}.AgnosticEncoders$PrimitiveIntEncoder$", True, loader).getField("MODULE$").get(None)
    none, fields = jvm.scala.Option.empty(), jvm.java.util.ArrayList()
    for name, encoder in (("datum", encoders.RowEncoder.encoderFor(df._jdf.schema())),
                          ("subsampleCounts", getattr(encoders, "AgnosticEncoders$ArrayEncoder")(whole, False))):
        fields.add(getattr(encoders, "AgnosticEncoders$EncoderField")(
            name, encoder, False, jvm.org.apache.spark.sql.types.Metadata.empty(), none, none))
    kind = jvm.scala.reflect.ClassTag.apply(jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint", True, loader))
    product = getattr(encoders, "AgnosticEncoders$ProductEncoder")(kind, jvm.org.apache.spark.api.python.PythonUtils.toSeq(fields), none)
    return DataFrame(spark._jsparkSession.createDataset(points, product).toDF(), spark)


def counted_by(est) -> tuple:
    """Estimators that agree in this, seed and weight, can share one count of the rows."""
    return est.getSeed(), est.getWeightCol() if est.isDefined("weightCol") else None


def grows(est, features: int) -> bool:
    """Whether the trees of ``est`` can be grown here: their draws fit a row, the sums of a level a task's memory."""
    if not isinstance(est, (RandomForestClassifier, GBTClassifier)):
        return False
    n = _tree_count(est) if isinstance(est, RandomForestClassifier) else 1
    return _tree_count(est) <= DRAWS and n * 2 ** max(0, est.getMaxDepth() - 1) * features * BINS * 4 <= LEVEL_NUMBERS


def _tree_count(est) -> int:
    return est.getNumTrees() if isinstance(est, RandomForestClassifier) else est.getMaxIter()


@dataclass
class Cells:
    """Rows counted by bins, label ``y`` and weight ``w``; column ``{name}{t}`` has how many of them tree t draws.

    As many features' bins as fit share one column ``k{i}``.
    """

    rows: DataFrame
    features: list[str]
    thresholds: list[np.ndarray]
    classes: int

    @property
    def bins(self) -> int:
        """Bins of the feature that has most (a sample's weight can give more than ``BINS``)."""
        return max(map(len, self.thresholds)) + 1

    @property
    def packed(self) -> list[list[int]]:
        """The features of each packed column."""
        d, n = len(self.features), 63 // bits(self.thresholds)
        return [list(range(first, min(d, first + n))) for first in range(0, d, n)]

    def unpacked(self, batch: pa.RecordBatch) -> np.ndarray:
        size, out = bits(self.thresholds), []
        for i, held in enumerate(self.packed):
            key = batch.column(f"k{i}").to_numpy()
            out += [key >> size * k & (1 << size) - 1 for k in range(len(held))]
        return np.column_stack(out)


def bits(thresholds: Sequence[np.ndarray]) -> int:
    """Bits for the bins of one feature."""
    return max(1, max(map(len, thresholds)).bit_length())


def count_cells(df: DataFrame, features: Sequence[str], label: str, ests: dict) -> Cells:
    """One pass that bins and counts the rows, with the draws of every estimator in ``ests`` by name."""
    (seed, weight_col), = {counted_by(e) for e in ests.values()}
    y = F.col(label).cast("double")
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    x = [F.col(c).cast("double") for c in features]
    n, total, top, bad = df.agg(
        F.count(F.lit(1)), F.sum(w), F.max(y), F.count_if(
            missing(y) | (y < 0) | (y != F.floor(y)) | missing(w) | (w < 0) | reduce(Column.__or__, map(missing, x)))).first()
    if not n or bad:
        raise ValueError(f"training needs rows with whole labels, weights and features: {bad} of {n} have not")
    thresholds = _thresholds(df, features, w, n, float(total), seed)
    named = df.select(*[c.alias(f"x{k}") for k, c in enumerate(x)], y.alias("y"), w.alias("w"))
    cut = [k for k, t in enumerate(thresholds) if len(t)]
    if cut:
        # a row lies left of a split up to and with the threshold
        named = Bucketizer(inputCols=[f"x{k}" for k in cut], outputCols=[f"bin{k}" for k in cut], splitsArray=[
            [-math.inf, *np.nextafter(thresholds[k], math.inf).tolist(), math.inf] for k in cut]).transform(named)
    cells = Cells(named, list(features), thresholds, int(top) + 1)
    keys = {f"k{i}": sum((F.shiftleft(F.col(f"bin{k}").cast("long"), bits(thresholds) * place) for place, k in enumerate(held) if k in cut),
                         F.lit(0).cast("long")) for i, held in enumerate(cells.packed)}
    rows, draws = named.select(*[c.alias(k) for k, c in keys.items()], "y", "w"), {}
    for name, est in ests.items():
        if isinstance(est, RandomForestClassifier):
            kept = [F.col(f"datum.{c}").alias(c) for c in rows.columns if c not in draws]
            rows = _drawn(rows, est).select(*kept, *[F.col("subsampleCounts")[t].alias(f"{name}{t}") for t in range(_tree_count(est))])
            draws |= {f"{name}{t}": F.sum(f"{name}{t}") for t in range(_tree_count(est))}
    for name, est in ests.items():
        if isinstance(est, GBTClassifier):
            # the numbers by which GBTClassifier keeps rows
            for t in range(_tree_count(est)):
                rows = rows.withColumn(f"{name}{t}", F.rand(est.getSeed() + t + 1))
                draws[f"{name}{t}"] = F.count_if(F.col(f"{name}{t}") < est.getSubsamplingRate())
    rows = rows.groupBy(*keys, "y", "w").agg(*[c.cast("long").alias(name) for name, c in draws.items()])
    return replace(cells, rows=stored(rows, "cells"))


def _level(cells: Cells, trees: Sequence[Tree], level: int, draws: Sequence[str], terms: Callable, sums: int) -> np.ndarray:
    """``sums`` sums per tree, node of the level, feature and bin.

    ``terms(bins, labels, weights, draws)`` of some cells gives what each sum adds; the last one adds the draws.
    """
    d, first, width = len(cells.features), 2 ** level - 1, 2 ** level
    bins, unpacked = cells.bins, replace(cells, rows=None).unpacked
    size, names = width * d * bins, [f"s{i}" for i in range(sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((sums, len(trees), size))
        for b in batches:
            x, y, w = unpacked(b), b.column("y").to_numpy(), b.column("w").to_numpy()
            for t, tree in enumerate(trees):
                c = b.column(draws[t]).to_numpy()
                at = tree.node(x) - first
                here = np.flatnonzero((at >= 0) & (c > 0))
                added = terms(x[here], y[here], w[here], c[here].astype(float))
                for k in range(d):
                    slot = (at[here] * d + k) * bins + x[here, k]
                    for s, term in enumerate(added):
                        out[s, t] += np.bincount(slot, term, size)
        flat = out.reshape(sums, -1)
        slots = np.flatnonzero(flat[-1])
        yield pa.RecordBatch.from_arrays([pa.array(slots), *map(pa.array, flat[:, slots])], names=["slot", *names])

    needed = [*[f"k{i}" for i in range(len(cells.packed))], "y", "w", *draws]
    found = cells.rows.select(*needed).mapInArrow(run, ", ".join(["slot long", *[f"{s} double" for s in names]])).groupBy("slot").agg(
        *[F.sum(s).alias(s) for s in names]).toArrow()
    out = np.zeros((len(trees) * size, sums))
    out[found["slot"].to_numpy()] = np.column_stack([found[s].to_numpy() for s in names])
    return out.reshape(len(trees), width, d, bins, sums)


def _best_splits(h: np.ndarray, thresholds: Sequence[np.ndarray], least: int, weight: Callable, impurity: Callable,
                 looked_at: np.ndarray) -> tuple:
    """Per node of ``h`` (nodes, features, bins, sums): best gain, its feature, split, left and right sums.

    Of equal gains the first in the node's list of features wins.
    """
    left = h.cumsum(2)[:, :, :-1]
    whole = h.sum(2, keepdims=True)
    right = whole - left
    with np.errstate(all="ignore"):
        gain = impurity(whole) - weight(left) / weight(whole) * impurity(left) - weight(right) / weight(whole) * impurity(right)
    possible = np.arange(h.shape[2] - 1) < np.array([len(t) for t in thresholds])[:, None]
    gain = np.where((gain >= 0) & possible & (left[..., -1] >= least) & (right[..., -1] >= least), gain, -np.inf)
    nodes = np.arange(len(h))
    feature = looked_at[nodes, np.take_along_axis(gain.max(2, initial=-np.inf), looked_at, 1).argmax(1)]
    split = gain[nodes, feature].argmax(1)
    return gain[nodes, feature, split], feature, split, left[nodes, feature, split], right[nodes, feature, split]


def _map_order(keys: Sequence[int], shift: int = 0) -> list[int]:
    """The order in which an immutable Scala map walks through small whole numbers."""
    if not shift and len(keys) <= 4:
        return sorted(keys, key=lambda k: (k % 16, k))
    places: dict = {}
    for k in keys:
        h = k + ~(k << 9) & 0xFFFFFFFF
        h ^= h >> 14
        h = h + (h << 4) & 0xFFFFFFFF
        places.setdefault((h ^ h >> 10) >> shift & 31, []).append(k)
    alone = [places[at][0] for at in sorted(places) if len(places[at]) == 1]
    return alone + [k for at in sorted(places) if len(places[at]) > 1 for k in _map_order(places[at], shift + 5)]


def _grow(cells: Cells, est, draws: Sequence[str], terms: Callable, sums: int, weight: Callable, impurity: Callable,
          value: Callable, choose: Callable | None = None) -> list[Tree]:
    """One tree per column of ``draws``, all grown level by level.

    ``choose()`` gives the features that the next node looks at (all without it); nodes take their turn as
    in pyspark.ml, where the last ones made come first.
    """
    d, depth = len(cells.features), est.getMaxDepth()
    turn, trees = [(t, 0) for t in reversed(range(len(draws)))], []
    for level in range(max(1, depth)):
        first = 2 ** level - 1
        h = _level(cells, trees or [Tree.empty(depth, 1)] * len(draws), level, draws, terms, sums)
        if not trees:
            for root in value(h[:, 0, 0].sum(1)):
                trees.append(Tree.empty(depth, len(root)))
                trees[-1].value[0] = root
        looked_at: dict = {}
        for t, at in turn if depth and cells.bins > 1 else ():
            looked_at.setdefault(t, {})[at] = choose() if choose else range(d)
        made = []
        for t in _map_order(list(looked_at)):
            nodes = list(looked_at[t])
            gain, feature, split, *sides = _best_splits(h[t][np.array(nodes) - first], cells.thresholds, est.getMinInstancesPerNode(),
                                                        weight, impurity, np.array([list(looked_at[t][at]) for at in nodes]))
            for i, at in enumerate(nodes):
                if gain[i] > 0:
                    trees[t].feature[at], trees[t].split[at] = feature[i], split[i]
                    for child, side in zip((2 * at + 1, 2 * at + 2), sides, strict=True):
                        trees[t].value[child] = value(side[i:i + 1])[0]
                        if abs(impurity(side[i])) >= EPSILON:
                            made.append((t, child))
        turn = made[::-1]
        if not turn:
            break
    return trees


def _forest(cells: Cells, est: RandomForestClassifier, name: str) -> TreeModel:
    classes, n, d = cells.classes, est.getNumTrees(), len(cells.features)
    jvm = cells.rows.sparkSession._jvm
    seeds, most = jvm.java.util.Random(est.getSeed()), math.ceil(math.sqrt(d)) if n > 1 else d

    def terms(x, y, w, c):
        return [*[w * c * (y == k) for k in range(classes)], c]

    def weight(s):
        return s[..., :-1].sum(-1)

    def gini(s):
        return 1.0 - ((s[..., :-1] / weight(s)[..., None]) ** 2).sum(-1)

    def shares(s):
        return s[..., :-1] / np.maximum(weight(s), 1e-300)[..., None]

    def choose():
        # a reservoir sample of the square root of their number
        chosen, rng = list(range(most)), jvm.org.apache.spark.util.random.XORShiftRandom(seeds.nextLong())
        for k in range(most, d):
            at = int(rng.nextDouble() * (k + 1))
            if at < most:
                chosen[at] = k
        return chosen

    trees = _grow(cells, est, [f"{name}{t}" for t in range(n)], terms, classes + 1, weight, gini, shares, choose if most < d else None)
    for tree in trees:
        # two leaves that say the same class are one
        for at in np.flatnonzero(tree.feature >= 0)[::-1]:
            if (tree.feature[2 * at + 1:2 * at + 3] < 0).all() and len(set(tree.value[2 * at + 1:2 * at + 3].argmax(1))) == 1:
                tree.feature[at] = -1
    return TreeModel(cells.features, cells.thresholds, False, trees, [1.0] * n)


def _boosted(cells: Cells, est: GBTClassifier, name: str) -> TreeModel:
    if cells.classes > 2:
        raise ValueError("boosted trees need labels 0 and 1")
    model = TreeModel(cells.features, cells.thresholds, True)

    def terms(x, y, w, c):
        y = 2.0 * y - 1.0
        # what the trees so far leave of log(1 + exp(-2 y F)): minus its slope
        r = 4.0 * y / (1.0 + np.exp(2.0 * y * model.raw(x)[:, 0])) if model.trees else y
        return [w * c, w * c * r, w * c * r * r, c]

    def weight(s):
        return s[..., 0]

    def variance(s):
        return (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0]

    def mean(s):
        return (s[..., 1] / np.maximum(s[..., 0], 1e-300))[..., None]

    for t in range(est.getMaxIter()):
        tree, = _grow(cells, est, [f"{name}{t}"], terms, 4, weight, variance, mean)
        model.trees.append(tree)
        model.rates.append(est.getStepSize() if t else 1.0)
    return model


def fit(cells: Cells, est, name: str) -> TreeModel:
    """The trees of ``est`` on counted rows; ``name`` is that of its draws."""
    return (_forest if isinstance(est, RandomForestClassifier) else _boosted)(cells, est, name)
