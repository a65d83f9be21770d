"""Scaling and PCA: properties of the reference's unit tests, plus persistence."""

import numpy as np
import pytest

from calibra.operators import features as FE


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(42)
    n = 100
    rows = [(float(a), float(b), float(c), int(e)) for a, b, c, e in
            zip(rng.normal(0, 1, n), rng.normal(5, 2, n), rng.normal(-2, 0.5, n), rng.integers(0, 2, n))]
    return spark.createDataFrame(rows, "feature1 double, feature2 double, feature3 double, exclude_me int")


def test_standard_scaler_population_std(spark, sample):
    m = FE.PopulationStandardScaler(excludeCols=["exclude_me"]).fit(sample)
    out = m.transform(sample).toPandas()
    for c in ("feature1", "feature2", "feature3"):
        assert abs(out[c].mean()) < 1e-9
        assert abs(out[c].std(ddof=0) - 1.0) < 1e-9
    assert (out["exclude_me"] == sample.toPandas()["exclude_me"]).all()


def test_standard_scaler_zero_variance_and_nan(spark):
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert FE.PopulationStandardScaler().fit(const).transform(const).first().x == 0.0
    bad = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0)], "x double, y double")
    with pytest.raises(ValueError, match="NaN"):
        FE.PopulationStandardScaler(["y"]).fit(bad)


def test_scaler_save_load(spark, sample, tmp_path):
    m = FE.PopulationStandardScaler(["feature1"]).fit(sample)
    m.write().overwrite().save(str(tmp_path / "scaler"))
    m2 = FE.PopulationStandardScalerModel.load(str(tmp_path / "scaler"))
    assert m2.getOrDefault("centers") == m.getOrDefault("centers")


def test_exact_quantiles_match_numpy(spark, sample):
    q = {(r.feature, r.prob): r.value for r in FE.exact_quantiles(sample, ["feature2"], [0.1, 0.25, 0.5, 0.9]).collect()}
    x = sample.toPandas()["feature2"].to_numpy()
    for p in (0.1, 0.25, 0.5, 0.9):
        assert q[("feature2", p)] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_robust_scaler(spark, sample):
    m = FE.RobustScaler(["feature1"]).fit(sample)
    x = sample.toPandas()["feature1"].to_numpy()
    assert m.getOrDefault("centers")[0] == pytest.approx(np.median(x))
    assert m.getOrDefault("scales")[0] == pytest.approx(np.quantile(x, 0.75) - np.quantile(x, 0.25))


def test_pca_matches_numpy_and_names(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(100, 8))
    x = np.hstack([base, base[:, :2] @ np.array([[0.5, 0.2], [0.1, 0.7]])])
    cols = [f"feature_{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    m = FE.CenteredPCA(cols, k=5).fit(df)
    out = m.transform(df)
    assert [c for c in out.columns] == [f"PC{i}" for i in range(1, 6)]
    ratios = m.getOrDefault("explained")
    assert all(0 <= r <= 1 for r in ratios) and abs(sum(ratios) - 1) < 1e-9
    xc = x - x.mean(0)
    vals = np.sort(np.linalg.eigvalsh(np.cov(xc.T, ddof=0)))[::-1]
    assert np.allclose(ratios, vals / vals.sum())
    pcs = out.toPandas().to_numpy()
    assert np.allclose(pcs.var(0), vals[:5])
    load = m.loadings(spark, 1).collect()
    assert load[0].importance >= load[-1].importance
    with pytest.raises(ValueError):
        m.loadings(spark, 11)


def test_pca_by_variance_threshold(spark, sample):
    cols = ["feature1", "feature2", "feature3"]
    m = FE.CenteredPCA(cols, k=0, varianceThreshold=0.95).fit(sample)
    cum = np.cumsum(m.getOrDefault("explained"))
    k = m.getOrDefault("k")
    assert cum[k - 1] >= 0.95 - 1e-12 and (k == 1 or cum[k - 2] < 0.95)
