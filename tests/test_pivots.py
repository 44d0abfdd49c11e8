"""Exact searches on cells around pivots against brute force."""

import numpy as np
import pytest

from kestrel.ml import pivots
from kestrel.ml.neighbors import knn, knn_wide


def points(spark, n, d, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d)) * 4
    x = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))
    x[: n // 4] = x[0]                      # a quarter of all rows is one point
    x[n // 4: n // 4 + 20] = np.round(x[n // 4: n // 4 + 20])
    rows = [(int(i), *map(float, v), "ab"[i % 2]) for i, v in enumerate(x)]
    cols = [f"c{k}" for k in range(d)]
    return spark.createDataFrame(rows, ["id", *cols, "cls"]).repartition(4), x, cols


def brute(x, k, cls=None):
    out = {}
    for i, v in enumerate(x):
        d = np.sqrt(np.cumsum((x - v) ** 2, 1)[:, -1])
        ok = [j for j in range(len(x)) if j != i and (cls is None or j % 2 == i % 2)]
        out[i] = sorted((d[j], j) for j in ok)[:k]
    return out


@pytest.mark.parametrize("cell_rows, by", [(512, ()), (24, ()), (24, ("cls",))])
def test_wide_neighbours_are_the_nearest(spark, cell_rows, by):
    df, x, cols = points(spark, 800, 12, 3)
    got = {}
    for r in knn_wide(df, df, "id", cols, 5, exclude_self=True, by=by, cell_rows=cell_rows).collect():
        got.setdefault(r.id, []).append((r._dist, r.nn_id))
    want = brute(x, 5, by or None)
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}


def test_wide_search_edges(spark):
    df, x, cols = points(spark, 60, 6, 1)
    few = df.where("id < 3")
    got = knn(df, few, "id", cols, 5, exclude_self=True)
    assert got.groupBy("id").count().where("id < 3 AND count = 2 OR id >= 3 AND count = 3").count() == 60
    assert knn_wide(df, df.limit(0), "id", cols, 5).count() == 0 and knn_wide(df.limit(0), df, "id", cols, 5).count() == 0
    missing = spark.createDataFrame([(900, *[None] * 6, "a"), (901, float("nan"), *[0.0] * 5, "b")], df.schema)
    both = knn_wide(df.unionByName(missing), df.unionByName(missing), "id", cols, 2)
    assert both.where("id >= 900 OR nn_id >= 900").count() == 0


def test_far_cells_are_not_met(spark):
    df, x, cols = points(spark, 2000, 8, 5, clusters=12)
    from pyspark.sql import functions as F
    ref = df.select(F.col("id").alias("_rid"), F.array(*cols).alias("_v"))
    cells = pivots.choose(ref, cell_rows=64)
    placed = pivots.with_cells(ref, cells)
    stats = pivots.spread(placed, [])
    met = pivots.meetings(ref.select(F.col("_rid").alias("_qid"), "_v", F.lit(1.0).alias("_reach")), cells, stats, [], 1.0)
    assert met.count() < 0.6 * 2000 * stats.count()


def ward(x, k):
    """Labels of exact Ward clustering, the cheapest pair merged each time; clusters by their smallest point."""
    own = [[i] for i in range(len(x))]
    c, w = [v.copy() for v in x], [1.0] * len(x)
    while len(own) > k:
        best = min((w[i] * w[j] / (w[i] + w[j]) * float(((c[i] - c[j]) ** 2).sum()), i, j)
                   for i in range(len(own)) for j in range(i))
        _, i, j = best
        c[j] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j])
        w[j] += w[i]
        own[j] += own[i]
        del own[i], c[i], w[i]
    order = sorted(own, key=lambda m: min(tuple(x[i]) for i in m))
    return {i: n for n, m in enumerate(order) for i in m}


@pytest.mark.parametrize("tail, cell_rows, ks", [(2048, 512, (1, 3, 6)), (30, 16, (4,))])
def test_ward_equals_brute_force(spark, tail, cell_rows, ks):
    from kestrel.ml.cluster import agglomerative
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3)) + rng.integers(0, 4, 90)[:, None] * 2.0
    x[70:] = x[0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(500, None, 1.0, 1.0)], "id int, a double, b double, c double")
    for k in ks:
        got = {r.id: r.cluster for r in agglomerative(df, ["a", "b", "c"], k, tail=tail, cell_rows=cell_rows).collect()}
        assert got.pop(500) is None and got == ward(x, k)


def test_wide_dbscan_equals_brute_force(spark):
    from kestrel.ml.cluster import dbscan_wide
    df, x, cols = points(spark, 300, 6, 11)
    got = {r.id: r.cluster for r in dbscan_wide(df, "id", cols, 2.0, 5, cell_rows=20).collect()}
    near = [np.flatnonzero(((x - v) ** 2).sum(1) <= 4.0) for v in x]
    core = {i for i, n in enumerate(near) if len(n) >= 5}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(label[j] for j in near[i] if j in core)
            changed, label[i] = changed or low < label[i], min(low, label[i])
    want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i in range(len(x))}
    assert got == want and len(set(want.values())) > 3


def test_ward_cells_merge_by_themselves(spark, monkeypatch):
    """Cells make most merges without a round over all of them, and the tree is that of brute force."""
    from kestrel.ml import cluster
    rounds = []
    mutual = cluster._mutual
    monkeypatch.setattr(cluster, "_mutual", lambda *a: rounds.append(1) or mutual(*a))
    rng = np.random.default_rng(4)
    x = np.c_[rng.uniform(0, 10, 220), rng.integers(0, 5, 220)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double")
    got = {r.id: r.cluster for r in cluster.agglomerative(df, ["a", "b"], 5, tail=25, cell_rows=10).collect()}
    assert got == ward(x, 5) and len(rounds) <= 1


def test_outside_cells_are_no_nearer_than_their_bound(spark):
    df, x, cols = points(spark, 1500, 3, 9)
    from pyspark.sql import functions as F
    ref = df.select(F.array(*cols).alias("_v"))
    cells = pivots.choose(ref, cell_rows=2, seed=1)
    cell, far = cells.assign(x)
    occupied = np.unique(cell)
    assert len(cells.first) < len(occupied)
    reach = np.array([far[cell == c].max() for c in occupied])
    for c in occupied[::40]:
        outside = pivots.Outside(cells, int(c), occupied, reach)
        own, low = x[cell == c], outside.distances(x[cell == c])
        for k, o in enumerate(occupied[outside.at]):
            assert (low[:, k] <= np.sqrt(pivots.squares(own, x[cell == o])).min(1)).all()
        assert low.max() > 0


def test_wide_dbscan_asks_whole_input_seldom(spark, monkeypatch):
    """Close points don't ask all cells, and chains between cells, lone points and close calls come out as by brute force."""
    from kestrel.ml.cluster import dbscan_wide
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 5)) * 0.4, rng.normal(size=(300, 5)) * 0.4 + 6.0, rng.normal(size=(40, 5)) * 6])
    x = np.concatenate([x, np.linspace(0, 6, 60)[:, None] * np.ones(5), [[20.0] * 5, [21.0] + [20.0] * 4, [22.0] + [20.0] * 4]])
    cols = [f"c{k}" for k in range(5)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["id", *cols]).repartition(3)
    asked, meet = [], pivots.meetings
    monkeypatch.setattr(pivots, "meetings", lambda q, *a: (asked.append(0 if len(a) > 4 and a[4] else q.count()), meet(q, *a))[1])
    got = {r.id: r.cluster for r in dbscan_wide(df, "id", cols, 1.0, 3, cell_rows=60).collect()}
    d2 = pivots.squares(x, x)
    near = d2 <= 1.0
    core = near.sum(1) >= 3
    label = np.arange(len(x))
    while True:
        low = np.where(near & core[None, :], label[None, :], len(x)).min(1)
        new = np.where(core, np.minimum(label, low), label)
        if (new == label).all():
            break
        label = new
    want = {i: int(label[i]) if core[i] else int(low[i]) if low[i] < len(x) else -1 for i in range(len(x))}
    assert got == want and -1 in want.values() and sum(asked) < 1.5 * len(x)


@pytest.mark.parametrize("by", [(), ("cls",)])
def test_wide_queries_are_not_sent_to_every_cell(spark, monkeypatch, by):
    """Rounds of few members find the neighbours of brute force, and only a query's nearest cells get a copy of it."""
    sent, meet = [], pivots.meetings

    def counted(q, *a, **b):
        met = meet(q, *a, **b)
        sent.append(met.count() / max(1, q.count()))
        return met

    monkeypatch.setattr(pivots, "meetings", counted)
    monkeypatch.setattr(pivots, "HELD", 12 * 100, raising=False)
    monkeypatch.setattr(pivots, "TILE", (64, 16), raising=False)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 12))                  # no structure: a query meets nearly all cells
    x[400:] = np.round(x[400:])                     # many equal distances
    x[560:] = x[400]
    cols = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame([(i, *map(float, v), "ab"[i % 2]) for i, v in enumerate(x)], ["id", *cols, "cls"]).repartition(3)
    got = {}
    for r in knn_wide(df, df, "id", cols, 5, exclude_self=True, by=by, cell_rows=30).collect():
        got.setdefault(r.id, []).append((r._dist, r.nn_id))
    assert {i: sorted(v) for i, v in got.items()} == brute(x, 5, by or None)
    assert sum(sent) < 3
