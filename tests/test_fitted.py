"""Discords, the forest and the robust covariance against slow versions and planted outliers."""

import math

import numpy as np
import pytest

from axlewatch.operators import fitted


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_discords_equal_the_quadratic_version(spark, block):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(150) / 3) + rng.normal(0, 0.05, 150)
    x[70:78] = [3, -3, 3, -3, 3, -3, 3, -3]
    x[20:35] = 1.0
    rows = [(1, i, float(v)) for i, v in enumerate(x)] + [(1, 1000, None), (2, 0, 1.0)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(3)
    got = {r.i: r.distance for r in fitted.discords(df, df, ["k"], ["i"], "v", 8, block, itself=True).collect()}
    z = fitted.normalised(x, 8)
    want = {i: min(math.dist(z[i], z[j]) for j in range(len(z)) if abs(i - j) >= 2) for i in range(len(z))}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert max(got, key=got.get) in range(63, 78)
    other = fitted.discords(df.where("i < 60"), df.where("i >= 80"), ["k"], ["i"], "v", 8, block)
    assert other.count() == 53 and fitted.discords(df.limit(0), df, ["k"], ["i"], "v", 8).count() == 0


def depth(nodes, row):
    k = 0
    while nodes[k][0] >= 0:
        f, cut, _ = nodes[k]
        k = 2 * k + (1 if row[f] < cut else 2)
    return nodes[k][2]


def test_forest_is_the_same_for_any_partitions_and_finds_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    x[:4] = [[9, 9], [-9, 9], [9, -9], [-9, -9]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    forests = [sorted(tuple(r) for r in fitted.isolation_forest(df.repartition(p), "i", ["a", "b"], trees=60, sample=64, pool=300).collect()) for p in (1, 6)]
    assert forests[0] == forests[1]
    forest = spark.createDataFrame(forests[0], "tree int, node long, feature int, cut double, depth double")
    got = {r.i: r.score for r in fitted.isolation_scores(df.repartition(4), forest, ["i"], ["a", "b"], 64).collect()}
    trees = {}
    for t, k, f, cut, d in forests[0]:
        trees.setdefault(t, {})[k] = (f, cut, d)
    for i in range(0, 600, 37):
        mean = sum(depth(n, x[i]) for n in trees.values()) / len(trees)
        assert got[i] == pytest.approx(2 ** (-mean / fitted.mean_depth(64)))
    assert set(sorted(got, key=got.get)[-4:]) == set(range(4))


def test_gross_outliers_do_not_move_the_centre(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]]) + [10, -5]
    x[:100] = rng.normal(size=(100, 2)) + [60, 60]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "i long, a double, b double").repartition(5)
    centre, cov, determinants = fitted.robust_covariance(df, ["a", "b"])
    assert determinants == sorted(determinants, reverse=True) and len(determinants) > 1
    assert np.abs(centre - x[100:].mean(axis=0)).max() < 0.35 and cov.max() < 12
    score = {r.i: r.score for r in fitted.robust_mahalanobis(df, df, ["a", "b"]).collect()}
    assert score[999] is None and min(score[i] for i in range(100)) > max(score[i] for i in range(100, 500))
    d = x[300] - centre
    assert score[300] == pytest.approx(math.sqrt(d @ np.linalg.inv(cov) @ d))


def test_principal_components_by_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) @ np.array([[1.0, 2.0, 0.1], [0.0, 0.3, 0.2], [0.0, 0.0, 0.5]]) + [5, 0, -3]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "i long, a double, b double, c double").repartition(3)
    got = {r.i: r for r in fitted.pca_spe_t2(df, df, ["a", "b", "c"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    n = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.9)) + 1
    v, lam = vectors[:, ::-1][:, :n], values[::-1][:n]
    spe, t2 = ((z - z @ v @ v.T) ** 2).sum(1), ((z @ v) ** 2 / lam).sum(1)
    score = spe / np.quantile(spe, 0.99) + t2 / np.quantile(t2, 0.99)
    assert all(got[i].score == pytest.approx(score[i], rel=1e-6) for i in range(300)) and got[999].score is None
