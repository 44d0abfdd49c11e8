"""Clustering metrics against brute force, with few clusters and with more than a thousand."""

import numpy as np
import pytest

from kestrel.operators import metrics


def brute(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels = sorted(set(c))
    own = {k: np.array(c) == k for k in labels}
    s = []
    for i, k in enumerate(c):
        if own[k].sum() == 1:
            s.append(0.0)
            continue
        a = d[i][own[k]].sum() / (own[k].sum() - 1)
        b = min(d[i][own[o]].mean() for o in labels if o != k)
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    mu = {k: x[own[k]].mean(0) for k in labels}
    far = {k: np.sqrt(((x[own[k]] - mu[k]) ** 2).sum(1)).mean() for k in labels}
    db = np.mean([max((far[i] + far[j]) / np.sqrt(((mu[i] - mu[j]) ** 2).sum()) for j in labels if j != i) for i in labels])
    w = sum(((x[own[k]] - mu[k]) ** 2).sum() for k in labels)
    b = sum(own[k].sum() * ((mu[k] - x.mean(0)) ** 2).sum() for k in labels)
    return np.mean(s), db, (b / (len(labels) - 1)) / (w / (len(x) - len(labels)))


@pytest.mark.parametrize("n, k", [(300, 4), (2400, 1200)])
def test_cluster_metrics_equal_brute_force(spark, n, k):
    rng = np.random.default_rng(k)
    c = np.concatenate([np.arange(k), rng.integers(0, k, n - k)])
    x = rng.normal(size=(n, 3)) * 0.3 + rng.normal(size=(k, 3))[c] * 3
    x[-20:], c[-20:] = x[0], c[0]
    rows = [(*map(float, v), f"c{j}") for v, j in zip(x, c)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, "c0"), (1.0, 1.0, 1.0, None)], "a double, b double, c double, cl string").repartition(3)
    got = [f(df, ["a", "b", "c"], "cl").first()[0] for f in (metrics.silhouette, metrics.davies_bouldin, metrics.calinski_harabasz)]
    assert np.allclose(got, brute(x, [f"c{j}" for j in c]), rtol=1e-9)


def test_cluster_metrics_edges(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "a"), (1.0, "a")], "x double, cl string")
    for f in (metrics.silhouette, metrics.calinski_harabasz):
        assert f(df, ["x"], "cl").first()[0] is None and f(df.limit(0), ["x"], "cl").first()[0] is None
    assert metrics.davies_bouldin(df.limit(0), ["x"], "cl").first()[0] is None


@pytest.mark.parametrize("d, cell_rows", [(1, 150), (2, 450), (4, None)])
def test_silhouette_of_far_cells_equals_brute_force(spark, d, cell_rows, monkeypatch):
    """Far cells meet by their nodes, also where an axis has no width, and no distance is left out."""
    rng = np.random.default_rng(d)
    x = rng.uniform(-3, 30, size=(4000, d))
    x[:, 1:] = np.where(rng.random((4000, d - 1)) < 0.7, np.floor(x[:, 1:] / 10), x[:, 1:] / 10)
    x[3990:] = x[0]
    c = [f"c{k}" for k in (rng.random(4000) < 0.05).astype(int)]
    df = spark.createDataFrame([(*map(float, v), k) for v, k in zip(x, c)], [*[f"a{k}" for k in range(d)], "cl"]).repartition(3)
    far, sums = [], metrics._far_sums
    monkeypatch.setattr(metrics, "_far_sums", lambda *a: (far.append(a[3].count()), sums(*a))[1])
    got = metrics.silhouette(df, [f"a{k}" for k in range(d)], "cl", cell_rows).first()[0]
    t = [np.zeros((4000, 2)), np.array([[k == "c0", k == "c1"] for k in c], float)]
    for lo in range(0, 4000, 500):
        t[0][lo:lo + 500] = np.sqrt(((x[lo:lo + 500, None] - x[None]) ** 2).sum(-1)) @ t[1]
    own, n = t[1] == 1, t[1].sum(0)
    a, b = t[0][own] / (n[np.nonzero(own)[1]] - 1), t[0][~own] / n[np.nonzero(~own)[1]]
    assert got == pytest.approx(((b - a) / np.maximum(a, b)).mean(), rel=1e-9)
    assert (far[0] > 0) == (d < 3)
