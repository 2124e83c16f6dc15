"""Covariances and components against NumPy; forests over purged folds find a planted feature."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import learning as L

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n=300):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 4))
    x[:, 1] = x[:, 0] * 0.9 + x[:, 1] * 0.2
    x[:, 3] = 5 + 1e6 * x[:, 3]
    y = (x[:, 2] + r.normal(0, 0.3, n) > 0).astype(int)
    rows = [(i, min(i + 4, n - 1), int(y[i]), *map(float, x[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "idx long, until long, label int, a double, b double, c double, d double").repartition(5)


def test_denoised_covariance(spark):
    x, _, df = table(spark)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    raw = np.cov(z, rowvar=False)
    values, vectors = np.linalg.eigh(raw)
    noise = values < (1 + math.sqrt(4 / 300)) ** 2
    values[noise] = values[noise].mean()
    want = vectors @ np.diag(values) @ vectors.T
    got = {(r["a"], r["b"]): r for r in L.denoised_covariance(df, COLUMNS).collect()}
    for i, a in enumerate(COLUMNS):
        for j, b in enumerate(COLUMNS):
            assert got[a, b]["raw"] == pytest.approx(raw[i, j], abs=1e-9) and got[a, b]["denoised"] == pytest.approx(want[i, j], abs=1e-9)
    flat = df.limit(9).withColumn("a", F.lit(3.0))
    assert L.denoised_covariance(flat, COLUMNS).where("a = 'a' AND b = 'a'").first()["raw"] == 0
    assert L.denoised_covariance(df.limit(0), COLUMNS).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.97, 0.9999999999999])
def test_principal_components(spark, share):
    x, _, df = table(spark)
    x, df = x / [1, 1, 1, 1e6], df.withColumn("d", F.col("d") / 1e6)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratio = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(ratio), share, side="right")) + 1
    rows, info = L.principal_components(df, COLUMNS, share)
    info = info.orderBy("component").collect()
    assert len(info) == min(k, 4) and [r["eigenvalue"] for r in info] == pytest.approx((s**2 / 299)[: len(info)].tolist())
    got = np.array([r[3:] for r in rows.orderBy("idx").collect()])
    want = (x - x.mean(axis=0)) @ v[: len(info)].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_meta_labels(spark):
    _, y, df = table(spark)
    got = L.meta_labels(df, COLUMNS, folds=4, tests=2, trees=10)
    folds = got["folds"].orderBy("fold").collect()
    assert len(folds) == 6 and all(f["test_size"] == 150 and f["train_size"] < 150 and f["f1"] > 0.8 for f in folds)
    # Test folds 2 and 3 (idx 150 and on): rows 0..145 are known before them.
    assert folds[5]["train_size"] == 146 and folds[5]["pos_rate_test"] == pytest.approx(y[150:].mean())
    assert got["importance"].orderBy(F.desc("mean")).first()["feature"] == "c"
    assert got["predictions"].count() == 300


def test_importances(spark):
    _, _, df = table(spark)
    assert L.importance_mdi(df, COLUMNS, trees=20).orderBy(F.desc("importance")).first()["feature"] == "c"
    mda = {r["feature"]: r for r in L.importance_mda(df, COLUMNS, "idx", repeats=2, trees=20).collect()}
    assert set(mda) == set(COLUMNS) and max(mda, key=lambda c: mda[c]["mean"]) == "c" and mda["c"]["mean"] > 0.2
