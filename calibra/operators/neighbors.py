"""Exact k-nearest neighbours and minority oversampling.

kNN is the pivot join of :mod:`calibra.operators.pivots`; the oversamplers draw
their synthetic rows from its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.columns import u01
from calibra.functions.frames import scalar
from calibra.operators.pivots import BLOCK_ROWS, knn_join

# Upper bound on (rows x dims) of a block that a task holds.
MAX_SHIPPED_VALUES = 1_000_000


def knn(query: DataFrame, ref: DataFrame, k: int, id_col: str = "id", features: str = "features",
        exclude_self: bool = True, carry: Sequence[str] = (),
        max_shipped_values: int = MAX_SHIPPED_VALUES, report: dict | None = None) -> DataFrame:
    """``(q_id, nn_id, distance, rank, <carry>...)`` - the exact k nearest
    reference rows of every query row (Euclidean; ties by neighbour id).

    ``carry`` are reference columns copied onto each neighbour row (e.g. its label).
    ``max_shipped_values`` bounds rows x dims of the blocks that tasks hold; rows
    without a vector are nobody's neighbours and have none.
    """
    one = ref.where(F.col(features).isNotNull()).select(F.size(features)).first()
    dims = max(1, one[0] if one else 1)
    rows = max(1, min(BLOCK_ROWS, max_shipped_values // dims))
    return knn_join(query, ref, k, id_col, features, exclude_self, carry, rows, report)


# ---------------------------------------------------------------- oversampling

def _class_counts(df: DataFrame, label: str) -> dict:
    """Per-class counts (one row per class, bounded by the number of classes)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def class_targets(counts: dict, strategy: str = "auto") -> dict:
    """Rows to add per class, up to the largest class.  ``auto`` and ``not majority``
    raise every class but the largest, ``minority`` the smallest one, ``not minority``
    every class but that, ``all`` every class."""
    smallest = min(counts, key=lambda c: (counts[c], c))
    largest = max(counts, key=lambda c: (counts[c], c))
    chosen = {
        "auto": lambda c: c != largest, "not majority": lambda c: c != largest,
        "minority": lambda c: c == smallest, "not minority": lambda c: c != smallest, "all": lambda c: True,
    }
    if strategy not in chosen:
        raise ValueError(f"sampling strategy must be one of {sorted(chosen)}, not {strategy!r}")
    return {c: counts[largest] - n for c, n in counts.items() if chosen[strategy](c) and n < counts[largest]}


def spread_evenly(bases: DataFrame, id_col: str, n_bases: int, n_new: int) -> DataFrame:
    """``id_col, n_generate``: ``n_new`` draws dealt to the base rows, the rest to the smallest ids."""
    more = F.when(F.col("_r") <= F.lit(n_new % n_bases), 1).otherwise(0)
    return running_sums_rank(bases.select(id_col), id_col).select(
        id_col, (F.lit(n_new // n_bases) + more).alias("n_generate"))


def smote(df: DataFrame, label: str, id_col: str, features: str, k: int = 5,
          seed: str = "smote", counts_per_base: DataFrame | None = None,
          neighbours: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """Oversample the classes that ``strategy`` names to the size of the largest.

    Each synthetic row is ``x + g * (nn - x)`` for a row x of the class, one of its
    k nearest neighbours nn in the class and g in [0,1), all three drawn from a
    hash of (base id, draw number), so the output is reproducible.  Draws are
    spread evenly over the class's rows; with ``counts_per_base`` (columns
    ``id_col, n_generate``, as in ADASYN) or ``neighbours`` only the smallest class
    is raised.  Output: original rows (``synthetic`` false) then synthetic rows with
    ``base_id``, ``neighbour_id``, ``gap``.  A class to raise needs more than k rows.
    """
    counts = _class_counts(df, label)
    out = df.select(id_col, label, features).withColumns({
        "synthetic": F.lit(False), "base_id": F.lit(None).cast("bigint"),
        "neighbour_id": F.lit(None).cast("bigint"), "gap": F.lit(None).cast("double")})
    if len(counts) < 2:
        return out
    single = counts_per_base is not None or neighbours is not None
    for cls, n_new in class_targets(counts, "minority" if single else strategy).items():
        if counts[cls] <= k:
            raise ValueError(f"class {cls!r} has {counts[cls]} rows, {k} neighbours need at least {k + 1}")
        m = df.where(F.col(label) == cls).select(id_col, features)
        nn = neighbours if neighbours is not None else knn(m, m, k, id_col, features)
        per_base = counts_per_base if counts_per_base is not None else spread_evenly(m, id_col, counts[cls], n_new)
        out = out.unionByName(_synthetic(df, m, nn, per_base, cls, n_new, label, id_col, features, seed))
    return out


def _synthetic(df: DataFrame, m: DataFrame, nn: DataFrame, per_base: DataFrame, cls, n_new: int,
               label: str, id_col: str, features: str, seed: str) -> DataFrame:
    """The synthetic rows of one class."""
    n_nn = nn.groupBy("q_id").agg(F.max("rank").alias("_nk"))
    # The draws outnumber the base rows by the class ratio: spread the (small)
    # base table over enough tasks before exploding it, ~1M draws per task.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_new // 1_000_000))
    per_base = per_base.select(id_col, "n_generate").repartition(parts, id_col)
    draws = per_base.where(F.col("n_generate") > 0).select(
        id_col, F.explode(F.sequence(F.lit(0), F.col("n_generate") - 1)).alias("draw"))
    draw_key = F.concat_ws("|", F.col(id_col).cast("string"), F.col("draw").cast("string"))
    draws = draws.join(n_nn, draws[id_col] == n_nn.q_id).select(
        id_col, "draw", (F.floor(u01(f"{seed}:nn", draw_key) * F.col("_nk")) + 1).cast("int").alias("_nr"),
        u01(f"{seed}:gap", draw_key).alias("gap"))
    picked = draws.join(nn.select(F.col("q_id").alias(id_col), F.col("rank").alias("_nr"), "nn_id"),
                        [id_col, "_nr"])
    base_f = m.select(F.col(id_col).alias("base_id"), F.col(features).alias("_x"))
    nb_f = m.select(F.col(id_col).alias("nn_id"), F.col(features).alias("_y"))
    syn = picked.withColumnRenamed(id_col, "base_id").join(base_f, "base_id").join(nb_f, "nn_id")
    new_x = F.zip_with("_x", "_y", lambda a, b: a + F.col("gap") * (b - a))
    return syn.select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
        F.lit(cls).cast(df.schema[label].dataType).alias(label),
        new_x.alias(features), F.lit(True).alias("synthetic"),
        "base_id", F.col("nn_id").alias("neighbour_id"), "gap")


def borderline_smote(df: DataFrame, label: str, id_col: str, features: str, k: int = 5, m: int = 10,
                     seed: str = "borderline") -> DataFrame:
    """SMOTE whose bases are the minority rows in danger; without any, nothing is added."""
    counts = _class_counts(df, label)
    n_new = max(counts.values(), default=0) - min(counts.values(), default=0)
    danger = borderline_danger(df, label, id_col, features, m).where("in_danger").select(id_col) \
        if len(counts) > 1 else None
    n_danger = danger.count() if danger is not None else 0
    bases = spread_evenly(danger, id_col, n_danger, n_new) if n_danger else df.select(
        id_col, F.lit(0).alias("n_generate")).limit(0)
    return smote(df, label, id_col, features, k, seed, counts_per_base=bases)


def adasyn(df: DataFrame, label: str, id_col: str, features: str, k: int = 5, seed: str = "adasyn") -> DataFrame:
    """SMOTE with more draws where more of a row's neighbours are of other classes."""
    counts = adasyn_counts(df, label, id_col, features, k) if len(_class_counts(df, label)) > 1 else None
    return smote(df, label, id_col, features, k, seed, counts_per_base=counts)


def running_sums_rank(df: DataFrame, id_col: str) -> DataFrame:
    """1-based rank by a unique id, computed with distributed prefix sums."""
    from calibra.functions.prefix import running_sums

    r = running_sums(df.withColumn("_one", F.lit(1)), [], id_col, ["_one"])
    return r.withColumnRenamed("cum__one", "_r").drop("_one", "tot__one")


def neighbour_majority(df: DataFrame, label: str, id_col: str, features: str, m: int,
                       minority) -> DataFrame:
    """Majority-class count among the m nearest rows (of all classes) of each minority row."""
    q = df.where(F.col(label) == minority).select(id_col, features)
    nn = knn(q, df.select(id_col, features, label), m, id_col, features, carry=[label])
    return nn.groupBy(F.col("q_id").alias(id_col)).agg(
        F.count_if(F.col(label) != F.lit(minority)).alias("n_majority"),
        F.count(F.lit(1)).alias("n_neighbours"))


def borderline_danger(df: DataFrame, label: str, id_col: str, features: str, m: int = 10,
                      minority=None) -> DataFrame:
    """Minority rows 'in danger': m/2 <= majority neighbours < m (m=10 of all rows)."""
    if minority is None:
        c = _class_counts(df, label)
        minority = min(c, key=lambda x: (c[x], x))
    nm = neighbour_majority(df, label, id_col, features, m, minority)
    return nm.select(id_col, "n_majority",
                     ((F.col("n_majority") >= m / 2.0) & (F.col("n_majority") < m)).alias("in_danger"),
                     (F.col("n_majority") == m).alias("noise"))


def adasyn_counts(df: DataFrame, label: str, id_col: str, features: str, k: int = 5,
                  minority=None) -> DataFrame:
    """Synthetic rows per minority row: rint(r_i / sum r * G), r_i = majority share of k neighbours."""
    c = _class_counts(df, label)
    if minority is None:
        minority = min(c, key=lambda x: (c[x], x))
    g_total = max(c.values()) - c[minority]
    nm = neighbour_majority(df, label, id_col, features, k, minority)
    ratio = F.col("n_majority") / F.lit(float(k))
    total = scalar(nm.agg(F.sum(ratio))) or 0.0  # one number
    share = F.try_divide(ratio, F.lit(float(total)))
    return nm.select(id_col, ratio.alias("ratio"),
                    F.coalesce(F.bround(share * g_total, 0), F.lit(0.0)).cast("int").alias("n_generate"))
