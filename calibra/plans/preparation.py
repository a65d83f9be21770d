"""Queries for splits, resampling, neighbours, scaling and PCA (R*, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibra.operators import features as FE
from calibra.operators import neighbors as NB
from calibra.operators import sampling as S
from calibra.plans.registry import query
from calibra.plans.sqlviews import U, with_views
from calibra.sources import views as V

SEED = "split42"
_KEY_SQL = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in V.TX_KEY) + ")"
_U_SQL = U(SEED, _KEY_SQL)
_ORDER = "_u, " + ", ".join(V.TX_KEY)


def _quota_sql(name: str, frac: float, counts: str) -> str:
    """Largest-remainder per-class quotas of a ``frac`` share, as CTEs ``{name}``."""
    f = repr(float(frac))
    return f"""
  {name}_fl AS (SELECT Class, n, floor({f} * n) AS f, {f} * n - floor({f} * n) AS r FROM {counts}),
  {name} AS (SELECT Class, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, Class)
                 <= (SELECT ceil({f} * sum(n)) - sum(f) FROM {name}_fl) THEN 1 ELSE 0 END AS BIGINT) AS quota
         FROM {name}_fl)"""


_RANKED_SQL = with_views("tx") + f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY {_ORDER}) AS _rank,
                count(*) OVER (PARTITION BY Class) AS _n
         FROM (SELECT *, {_U_SQL} AS _u FROM tx)),
  cnt AS (SELECT Class, count(*) AS n FROM tx GROUP BY Class),"""


@query("stratified_split",
       sql=_RANKED_SQL + _quota_sql("tq", 0.2, "cnt") + f"""
SELECT {', '.join(V.TX_KEY)}, rk.Class, CASE WHEN _rank <= quota THEN 'test' ELSE 'train' END AS split
FROM rk JOIN tq ON rk.Class = tq.Class""")
def stratified_split(spark, sf_dir):
    """Exact stratified 80/20 split, sticky per key."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, "Class")
    return S.stratified_split(t, "Class", V.TX_KEY, 0.2, SEED)


@query("split_counts",
       sql=_RANKED_SQL + _quota_sql("tq", 0.2, "cnt") + """
SELECT split, Class, count(*) AS n FROM (
  SELECT rk.Class, CASE WHEN _rank <= quota THEN 'test' ELSE 'train' END AS split
  FROM rk JOIN tq ON rk.Class = tq.Class) GROUP BY ALL""")
def split_counts(spark, sf_dir):
    """Rows per split and class (proportions kept per class)."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, "Class")
    return S.stratified_split(t, "Class", V.TX_KEY, 0.2, SEED).groupBy("split", "Class").agg(
        F.count(F.lit(1)).alias("n"))


@query("three_way_split",
       sql=_RANKED_SQL + _quota_sql("tq", 0.2, "cnt") + """,
  rest AS (SELECT Class, n - quota AS n FROM tq),""" + _quota_sql("vq", S.val_fraction(0.2, 0.2), "rest") + f"""
SELECT {', '.join(V.TX_KEY)}, rk.Class,
       CASE WHEN _rank <= tq.quota THEN 'test' WHEN _rank <= tq.quota + vq.quota THEN 'val' ELSE 'train' END AS split
FROM rk JOIN tq ON rk.Class = tq.Class JOIN vq ON rk.Class = vq.Class""")
def three_way_split(spark, sf_dir):
    """R2: exact stratified 60/20/20 train/val/test split."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, "Class")
    return S.three_way_split(t, "Class", V.TX_KEY, 0.2, 0.2, SEED)


@query("fold_assignment",
       sql=_RANKED_SQL.rstrip(",") + f"""
, f AS (SELECT *, _rank - 1 AS i, _n // 5 AS q, _n - (_n // 5) * 5 AS rem FROM rk)
SELECT {', '.join(V.TX_KEY)}, Class,
       CAST(CASE WHEN i < (q + 1) * rem THEN floor(i / (q + 1)) ELSE rem + floor((i - (q + 1) * rem) / q) END
            AS INTEGER) AS fold
FROM f""")
def fold_assignment(spark, sf_dir):
    """Stratified 5-fold assignment (feeds CrossValidator(foldCol=...))."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, "Class")
    return S.fold_assignment(t, "Class", V.TX_KEY, 5, SEED)


# ---------------------------------------------------------------- neighbours / oversampling

_DIST_SQL = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


@query("knn_exact",
       sql=with_views("imbalanced") + f"""
, d AS (SELECT a.vec_id AS q_id, b.vec_id AS nn_id, {_DIST_SQL} AS distance
        FROM imbalanced a JOIN imbalanced b ON a.vec_id <> b.vec_id)
SELECT q_id, nn_id, distance, CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, nn_id) AS INTEGER) AS rank
FROM d QUALIFY rank <= 5""",
       rounded="distance")
def knn_exact(spark, sf_dir):
    """Exact 5 nearest neighbours of every embedding."""
    e = V.imbalanced(spark, sf_dir)
    return NB.knn(e, e, 5, "vec_id", "features")


_NMAJ_SQL = with_views("imbalanced") + f"""
, d AS (SELECT a.vec_id AS q_id, b.vec_id AS nn_id, b.Class AS nn_class, {{dist}} AS distance
        FROM (SELECT * FROM imbalanced WHERE Class = 1) a JOIN imbalanced b ON a.vec_id <> b.vec_id),
  top AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY distance, nn_id) <= {{m}}),
  nm AS (SELECT q_id AS vec_id, count_if(nn_class <> 1) AS n_majority FROM top GROUP BY q_id)
"""


@query("borderline_danger",
       sql=_NMAJ_SQL.format(dist=_DIST_SQL, m=10) + """
SELECT vec_id, n_majority, n_majority >= 5.0 AND n_majority < 10 AS in_danger, n_majority = 10 AS noise FROM nm""")
def borderline_danger(spark, sf_dir):
    """Minority embeddings in danger (5 <= majority neighbours < 10 of 10)."""
    return NB.borderline_danger(V.imbalanced(spark, sf_dir), "Class", "vec_id", "features", 10, minority=1)


@query("adasyn_counts",
       sql=_NMAJ_SQL.format(dist=_DIST_SQL, m=5) + """
, g AS (SELECT count_if(Class = 0) - count_if(Class = 1) AS g FROM imbalanced),
  s AS (SELECT sum(n_majority / 5.0) AS s FROM nm)
SELECT vec_id, n_majority / 5.0 AS ratio,
       CAST(coalesce(round_even((n_majority / 5.0) / NULLIF(s, 0) * g, 0), 0.0) AS INTEGER) AS n_generate
FROM nm, g, s""",
       rounded="ratio")
def adasyn_counts(spark, sf_dir):
    """Synthetic rows per minority embedding under ADASYN."""
    return NB.adasyn_counts(V.imbalanced(spark, sf_dir), "Class", "vec_id", "features", 5, minority=1)


@query("smote_counts",
       sql=with_views("imbalanced") + """
, c AS (SELECT Class, count(*) AS n_before FROM imbalanced GROUP BY Class)
SELECT Class, n_before, max(n_before) OVER () AS n_after, max(n_before) OVER () - n_before AS added FROM c""")
def smote_counts(spark, sf_dir):
    """Class counts before and after SMOTE to parity."""
    e = V.imbalanced(spark, sf_dir)
    out = NB.smote(e, "Class", "vec_id", "features", k=5)
    info = S.sampling_info(e, out, "Class", "SMOTE")
    return info.select("Class", "n_before", "n_after", "added")


@query("sampling_info",
       sql=with_views("imbalanced") + """
, c AS (SELECT Class, count(*) AS n_before FROM imbalanced GROUP BY Class)
SELECT 'SMOTE' AS method, Class, n_before, max(n_before) OVER () AS n_after,
       max(n_before) OVER () - n_before AS added FROM c""")
def sampling_info(spark, sf_dir):
    """Resampling report (method, counts before/after, added)."""
    e = V.imbalanced(spark, sf_dir)
    return S.sampling_info(e, NB.smote(e, "Class", "vec_id", "features", k=5), "Class", "SMOTE")


def _long_features(rows):
    """One row per row and dimension: ``dim``, ``value``."""
    return rows.select("vec_id", "Class", "synthetic", "base_id", "neighbour_id", "gap",
                       F.posexplode("features").alias("dim", "value"))


def _resampled_sql(seed: str, bases: str) -> str:
    """Originals and synthetic rows; ``bases`` is a CTE body of ``vec_id, n_generate``."""
    return _NMAJ_SQL + f"""
, c AS (SELECT count_if(Class = 1) AS n_min, count_if(Class = 0) - count_if(Class = 1) AS n_new FROM imbalanced),
  own AS (SELECT a.vec_id AS q_id, b.vec_id AS nn_id, {_DIST_SQL} AS distance
          FROM imbalanced a JOIN imbalanced b ON a.vec_id <> b.vec_id AND a.Class = 1 AND b.Class = 1),
  nn AS (SELECT q_id, nn_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, nn_id) AS rank
         FROM own QUALIFY rank <= 5),
  bases AS ({bases}),
  draws AS (SELECT vec_id, unnest(range(n_generate)) AS draw FROM bases),
  keyed AS (SELECT vec_id, concat_ws('|', CAST(vec_id AS VARCHAR), CAST(draw AS VARCHAR)) AS key FROM draws),
  picked AS (SELECT vec_id, {U(seed + ':gap', 'key')} AS gap,
                    CAST(floor({U(seed + ':nn', 'key')} * 5) AS BIGINT) + 1 AS rank FROM keyed),
  synthetic AS (
    SELECT a.vec_id AS base_id, b.vec_id AS neighbour_id, p.gap,
           list_transform(list_zip(a.features, b.features), lambda x: x[1] + p.gap * (x[2] - x[1])) AS features
    FROM picked p JOIN nn ON nn.q_id = p.vec_id AND nn.rank = p.rank
    JOIN imbalanced a ON a.vec_id = p.vec_id JOIN imbalanced b ON b.vec_id = nn.nn_id),
  rows AS (
    SELECT vec_id, Class, false AS synthetic, NULL::BIGINT AS base_id, NULL::BIGINT AS neighbour_id,
           NULL::DOUBLE AS gap, features FROM imbalanced
    UNION ALL SELECT NULL, 1, true, base_id, neighbour_id, gap, features FROM synthetic)
SELECT vec_id, Class, synthetic, base_id, neighbour_id, gap,
       unnest(range(len(features)))::INTEGER AS dim, unnest(features) AS value FROM rows"""


_EVEN_SQL = """SELECT vec_id, CAST(n_new // count(*) OVER ()
         + CASE WHEN row_number() OVER (ORDER BY vec_id) <= n_new % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT)
         AS n_generate
         FROM {rows}, c WHERE {cond}"""


@query("smote_rows",
       sql=_resampled_sql("smote", _EVEN_SQL.format(rows="imbalanced", cond="Class = 1")).format(dist=_DIST_SQL, m=5),
       rounded="gap value")
def smote_rows(spark, sf_dir):
    """The oversampled table itself (originals + synthetic rows), a row per dimension."""
    return _long_features(NB.smote(V.imbalanced(spark, sf_dir), "Class", "vec_id", "features", k=5))


@query("borderline_rows",
       sql=_resampled_sql("borderline", _EVEN_SQL.format(rows="nm", cond="n_majority >= 5.0 AND n_majority < 10"))
       .format(dist=_DIST_SQL, m=10),
       rounded="gap value")
def borderline_rows(spark, sf_dir):
    """The table oversampled from the minority rows in danger, a row per dimension."""
    return _long_features(NB.borderline_smote(V.imbalanced(spark, sf_dir), "Class", "vec_id", "features"))


@query("adasyn_rows",
       sql=_resampled_sql("adasyn", """SELECT vec_id, CAST(coalesce(round_even((n_majority / 5.0)
         / NULLIF((SELECT sum(n_majority / 5.0) FROM nm), 0) * n_new, 0), 0.0) AS INTEGER) AS n_generate FROM nm, c""")
       .format(dist=_DIST_SQL, m=5),
       rounded="gap value")
def adasyn_rows(spark, sf_dir):
    """The table oversampled by ADASYN, a row per dimension."""
    return _long_features(NB.adasyn(V.imbalanced(spark, sf_dir), "Class", "vec_id", "features"))


# ---------------------------------------------------------------- scaling / PCA

_STATS_SQL = ", ".join(f"avg({f}) AS m_{f}, coalesce(NULLIF(stddev_pop({f}), 0), 1.0) AS s_{f}"
                       for f in V.TX_FEATURES)


@query("standard_scale",
       sql=with_views("tx") + f"""
, st AS (SELECT {_STATS_SQL} FROM tx)
SELECT {', '.join(V.TX_KEY)}, Class, """ + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in V.TX_FEATURES)
       + " FROM tx, st",
       rounded=" ".join(V.TX_FEATURES))
def standard_scale(spark, sf_dir):
    """population-std scaling of the transaction features."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, *V.TX_FEATURES, "Class")
    model = FE.PopulationStandardScaler(V.TX_FEATURES).fit(t)
    return model.transform(t)


@query("exact_quantiles",
       sql=with_views("tx") + """
SELECT feature, prob, value FROM (
""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {p} AS prob, quantile_cont({f}, {p}) AS value FROM tx"
                         for f in V.TX_FEATURES for p in (0.25, 0.5, 0.75)) + ")",
       rounded="prob value")
def exact_quantiles(spark, sf_dir):
    """exact quartiles per feature from distributed ranks."""
    return FE.exact_quantiles(V.tx(spark, sf_dir), V.TX_FEATURES, [0.25, 0.5, 0.75])


@query("robust_scale",
       sql=with_views("tx") + """
, st AS (SELECT """ + ", ".join(
           f"quantile_cont({f}, 0.5) AS c_{f}, "
           f"coalesce(NULLIF(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 0), 1.0) AS s_{f}"
           for f in V.TX_FEATURES) + f""" FROM tx)
SELECT {', '.join(V.TX_KEY)}, """ + ", ".join(f"({f} - c_{f}) / s_{f} AS {f}" for f in V.TX_FEATURES)
       + " FROM tx, st",
       rounded=" ".join(V.TX_FEATURES))
def robust_scale(spark, sf_dir):
    """(x - median) / IQR."""
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, *V.TX_FEATURES)
    return FE.RobustScaler(V.TX_FEATURES).fit(t).transform(t)


#: prices in thousands, so that six decimals of every covariance are sure
_THOUSANDS = "l_extendedprice"


@query("covariance_matrix",
       sql=with_views("tx") + f"""
, t AS (SELECT * REPLACE ({_THOUSANDS} / 1000 AS {_THOUSANDS}) FROM tx)
SELECT feature_i, feature_j, covariance FROM (
""" + " UNION ALL ".join(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, covar_pop({a}, {b}) AS covariance FROM t"
                         for a in V.TX_FEATURES for b in V.TX_FEATURES) + ")",
       rounded="covariance")
def covariance_matrix(spark, sf_dir):
    """population covariance matrix of the transaction features."""
    t = V.tx(spark, sf_dir).withColumn(_THOUSANDS, F.col(_THOUSANDS) / 1000)
    return FE.covariance_long(t, V.TX_FEATURES)


@query("embedding_covariance",
       sql=with_views("imbalanced") + """
, m AS (SELECT unnest(range(64)) AS i),
  x AS (SELECT vec_id, i, features[i + 1] AS v FROM imbalanced, m)
SELECT 'features_' || a.i AS feature_i, 'features_' || b.i AS feature_j,
       CASE WHEN abs(covar_pop(a.v, b.v)) < 5e-7 THEN 0.0 ELSE covar_pop(a.v, b.v) END AS covariance
FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""",
       rounded="covariance")
def embedding_covariance(spark, sf_dir):
    """covariance of all 64 dimensions of the embeddings, from block products."""
    cov = FE.block_covariance(V.imbalanced(spark, sf_dir), ["features"])
    # engines differ in the sign of a rounded zero
    return cov.withColumn("covariance", F.when(F.abs("covariance") < 5e-7, 0.0).otherwise(F.col("covariance")))


@query("embedding_pca")
def embedding_pca(spark, sf_dir):
    """explained variance of every component of the 64-dimensional embeddings."""
    names = [f"e{i}" for i in range(64)]
    wide = V.imbalanced(spark, sf_dir).select(*[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    return FE.CenteredPCA(names, varianceThreshold=0.95).fit(wide).explained_variance(spark)


def _pca(spark, sf_dir, k=0):
    t = V.tx(spark, sf_dir).select(*V.TX_KEY, *V.TX_FEATURES)
    scaled = FE.PopulationStandardScaler(V.TX_FEATURES).fit(t).transform(t)
    return scaled, FE.CenteredPCA(V.TX_FEATURES, k=k, varianceThreshold=0.95).fit(scaled)


@query("pca_scores")
def pca_scores(spark, sf_dir):
    """Scale -> PCA (95 % variance) scores of every transaction."""
    scaled, model = _pca(spark, sf_dir)
    return model.transform(scaled)


@query("pca_explained_variance")
def pca_explained_variance(spark, sf_dir):
    """explained variance ratio per component of the scaled transaction features."""
    _, model = _pca(spark, sf_dir)
    return model.explained_variance(spark)


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    """|loading| importance of every feature in every component."""
    _, model = _pca(spark, sf_dir, k=len(V.TX_FEATURES))
    return model.loadings(spark)
