import numpy as np
import pytest

from tidemark.plans import cluster


@pytest.mark.parametrize("n,m", [(40, 25), (12, 60), (3, 2), (30, 30)])
def test_components_against_the_whole_decomposition(n, m):
    a = np.random.default_rng(n).random((n, m)) < 0.2
    a[0] = True
    got = cluster.incidence_components([[f"i{j}" for j in np.flatnonzero(row)] * 2 for row in a])
    u, s, _ = np.linalg.svd(a[:, a.any(0)].astype(float), full_matrices=False)
    k = min(8, n - 1, m - 1)
    assert got.shape == (n, k)
    # coordinates are held to by their products, which don't hang on signs; inner ones of equal size may turn
    assert np.allclose(np.linalg.norm(got, axis=0), s[:k], rtol=1e-2)
    assert np.allclose(np.abs(got[:, :1]), np.abs(u[:, :1] * s[0]), atol=1e-6)


def test_rows_without_items():
    assert cluster.incidence_components([None, [], [None]]).shape == (3, 0)
    got = cluster.incidence_components([["a", "b"], None, ["b", "c"], ["a"]])
    assert got.shape == (4, 2) and np.allclose(got[1], 0)


def test_items_part_rows_that_features_cannot(spark):
    rows = [("c", k, 1.0, ["x", "y"] if k % 2 else ["u", "v"]) for k in range(60)] + [("c", 60, 1.0, ["w"]), ("c", 61, 1.0, None)]
    d = spark.createDataFrame(rows, "t string, k long, f double, who array<string>")
    plain = {r.cluster for r in cluster.outliers(d, "t", "k", ["f"], eps=0.3).collect()}
    got = {r.k: r.cluster for r in cluster.outliers(d, "t", "k", ["f"], eps=0.3, items="who").collect()}
    assert plain == {0} and got[0] != got[1] and {got[k] for k in range(0, 60, 2)} == {got[0]} and {got[k] for k in range(1, 60, 2)} == {got[1]} and got[60] == got[61] == -1
