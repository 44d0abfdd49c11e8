"""Clustering: k-means (MLlib), DBSCAN on an epsilon grid or on cells around pivots,
exact Ward agglomeration by rounds of mutual nearest clusters.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut_lineage
from . import pivots
from .models import features_vector, split_complete

DEFAULT_K = 3            # reference default number of clusters
DEFAULT_EPS = 0.5        # reference DBSCAN defaults (library defaults)
DEFAULT_MIN_SAMPLES = 5
WARD_TAIL = 2_048        # clusters that are left to one task
WARD_CELLS = 4           # cells in which clusters merge by themselves hold so many times the rows of other cells
WARD_STALL = 0.9         # where more than this share of the clusters is left, mutual pairs of all cells follow
DELEGATES = 16           # points of a cluster that ask all cells for other clusters first
GRID_COLUMNS = 3         # a grid's neighbourhood grows with the power of the columns


def kmeans(df: DataFrame, cols, k: int = DEFAULT_K, seed: int = 42, out: str = "cluster"):
    """(DataFrame with ``cluster``, fitted MLlib model). Rows with a missing feature
    take no part in the fit and keep a NULL cluster."""
    ok, missing = split_complete(df, cols)
    d = features_vector(ok, cols, "_features")
    m = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out).fit(d)
    found = m.transform(d).drop("_features")
    return found.unionByName(missing.withColumn(out, F.lit(None).cast("int"))), m


def dbscan(df: DataFrame, id_col: str, cols, eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES,
           out: str = "cluster", sub: int = 4) -> DataFrame:
    """DBSCAN (neighbourhood counts include the point itself); noise = -1.

    Grid of side eps / sqrt(d): two points of one cell are always within eps,
    so a cell holding >= min_samples points makes all its points core without
    any distance test. Every cell is split into ``sub``^d sub-cells; the
    occupancy of sub-cells (counts, smallest label) answers most questions
    without looking at point pairs:

    * a sub-cell whose farthest corner is within eps of a point counts whole
      towards that point's neighbourhood, one entirely beyond eps not at all;
      only sub-cells straddling the eps circle are tested point by point;
    * two core cells are linked as soon as one pair of their occupied core
      sub-cells is entirely within eps; point pairs are tested only for the
      straddling sub-cell pairs of cell pairs not linked that way.

    Clusters are connected components of the core-cell graph, found by rounds of
    large-star and small-star steps until nothing changes; border points take the
    smallest cluster label of a core point within eps. Cluster ids are the
    smallest point id of the cluster. Points with a NULL or NaN coordinate are
    within eps of nothing: noise. More than ``GRID_COLUMNS`` columns go to ``dbscan_wide``.
    """
    cols = list(cols)
    d = len(cols)
    if d > GRID_COLUMNS:
        return dbscan_wide(df, id_col, cols, eps, min_samples, out)
    everything = df
    df = df.where(F.forall(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x)))
    side = eps / math.sqrt(d)
    ss = side / sub
    e2 = F.lit(eps * eps)
    ck = [f"_c{i}" for i in range(d)]
    sk = [f"_s{i}" for i in range(d)]
    P = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    P = P.select("*", *[F.floor(F.col(c) / F.lit(ss)).cast("long").alias(sk[i]) for i, c in enumerate(cols)])
    P = P.select("*", *[F.floor(F.col(sk[i]) / F.lit(sub)).cast("long").alias(ck[i]) for i in range(d)])
    occ = P.groupBy(*ck).agg(F.count(F.lit(1)).alias("_occ"))
    P = cut_lineage(P.join(occ, ck))

    def near_subcells(q: DataFrame, reach_sub: int) -> DataFrame:
        """Explode query points (columns _q_{c}) to the sub-cells within reach."""
        offs = [o for o in itertools.product(range(-reach_sub, reach_sub + 1), repeat=d)]
        base = [F.floor(F.col(f"_q_{c}") / F.lit(ss)).cast("long") for c in cols]
        return q.select("*", F.explode(F.array(*[F.struct(*[(base[i] + F.lit(o[i])).alias(sk[i]) for i in range(d)])
                                                 for o in offs])).alias("_n")).select("*", "_n.*").drop("_n")

    def sub_bounds(prefix=""):
        """(min, max) squared distance from a query point to a sub-cell box."""
        lo_terms, hi_terms = [], []
        for i, c in enumerate(cols):
            a = F.col(sk[i]) * F.lit(ss)
            b = a + F.lit(ss)
            q = F.col(f"_q_{c}")
            near = F.greatest(a - q, F.lit(0.0), q - b)
            far = F.greatest(F.abs(q - a), F.abs(q - b))
            lo_terms.append(near * near)
            hi_terms.append(far * far)
        return sum(lo_terms), sum(hi_terms)

    reach_sub = int(math.ceil(eps / ss))
    lo2, hi2 = sub_bounds()
    dist2 = sum((F.col(c) - F.col(f"_q_{c}")) ** 2 for c in cols)

    # ---- core flags: sparse-cell points count neighbours via sub-cell counts
    subcnt = P.groupBy(*sk).agg(F.count(F.lit(1)).alias("_k"))
    Q = P.where(F.col("_occ") < min_samples).select(F.col("_id").alias("_qid"),
                                                     *[F.col(c).alias(f"_q_{c}") for c in cols])
    QS = near_subcells(Q, reach_sub).join(subcnt, sk).withColumn("_lo2", lo2).withColumn("_hi2", hi2) \
        .where(F.col("_lo2") <= e2)
    whole = QS.where(F.col("_hi2") <= e2).groupBy("_qid").agg(F.sum("_k").alias("_w"))
    ring = (QS.where(F.col("_hi2") > e2).select("_qid", *[f"_q_{c}" for c in cols], *sk)
            .join(P.select("_id", *cols, *sk), sk).where(dist2 <= e2)
            .groupBy("_qid").agg(F.count(F.lit(1)).alias("_r")))
    cnt = (whole.join(ring, "_qid", "full").select(
        "_qid", (F.coalesce("_w", F.lit(0)) + F.coalesce("_r", F.lit(0))).alias("_nb")))
    P = (P.join(cnt.withColumnRenamed("_qid", "_id"), "_id", "left")
         .withColumn("_core", (F.col("_occ") >= min_samples) | (F.coalesce("_nb", F.lit(0)) >= min_samples)))
    P = cut_lineage(P)
    core = P.where("_core")

    # ---- links between core cells from occupied core sub-cells
    CS = core.select(*ck, *sk).distinct()
    reach = int(math.ceil(math.sqrt(d)))
    coffs = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if any(o)]
    A = CS.select(*[F.col(k).alias(f"_a{k}") for k in ck + sk],
                  F.explode(F.array(*[F.struct(*[(F.col(ck[i]) + F.lit(o[i])).alias(ck[i]) for i in range(d)])
                                      for o in coffs])).alias("_n")).select("*", "_n.*").drop("_n")
    SP = A.join(CS, ck)
    gap = [F.abs(F.col(f"_a{sk[i]}") - F.col(sk[i])) for i in range(d)]
    smin2 = sum((F.greatest(g - 1, F.lit(0)) * F.lit(ss)) ** 2 for g in gap)
    smax2 = sum(((g + 1) * F.lit(ss)) ** 2 for g in gap)
    node_a = F.struct(*[F.col(f"_a{ck[i]}").alias(f"_a{i}") for i in range(d)])
    node_b = F.struct(*[F.col(ck[i]).alias(f"_a{i}") for i in range(d)])
    SP = SP.select(node_a.alias("src"), node_b.alias("dst"), *[f"_a{k}" for k in sk], *sk,
                   smin2.alias("_mn"), smax2.alias("_mx")).where(F.col("_mn") <= e2)
    sure = SP.where(F.col("_mx") <= e2).select("src", "dst").distinct()
    amb = SP.where(F.col("_mx") > e2).join(sure, ["src", "dst"], "left_anti")
    pa = core.select(*[F.col(c).alias(f"_q_{c}") for c in cols], *[F.col(k).alias(f"_a{k}") for k in sk])
    pb = core.select(*cols, *sk)
    checked = (amb.join(pa, [f"_a{k}" for k in sk]).join(pb, sk).where(dist2 <= e2)
               .select("src", "dst").distinct())
    edges = sure.unionByName(checked).distinct()
    cells = core.groupBy(F.struct(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(ck)]).alias("node")) \
                .agg(F.min("_id").alias("label"))
    labels = _components(cells, edges)
    core_lab = (core.select("_id", *cols, *sk, F.struct(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(ck)]).alias("node"))
                .join(labels, "node"))

    # ---- border points: smallest label of a core point within eps
    sublab = core_lab.groupBy(*sk).agg(F.min("label").alias("_lab"))
    NC = P.where(~F.col("_core")).select(F.col("_id").alias("_qid"), *[F.col(c).alias(f"_q_{c}") for c in cols])
    NS = near_subcells(NC, reach_sub).join(sublab, sk).withColumn("_lo2", lo2).withColumn("_hi2", hi2) \
        .where(F.col("_lo2") <= e2)
    b_whole = NS.where(F.col("_hi2") <= e2).groupBy("_qid").agg(F.min("_lab").alias("_l1"))
    b_ring = (NS.where(F.col("_hi2") > e2).select("_qid", *[f"_q_{c}" for c in cols], *sk)
              .join(core_lab.select("label", *cols, *sk), sk).where(dist2 <= e2)
              .groupBy("_qid").agg(F.min("label").alias("_l2")))
    border = (b_whole.join(b_ring, "_qid", "full")
              .select(F.col("_qid").alias("_id"), F.least("_l1", "_l2").alias("label")))
    lab = core_lab.select("_id", "label").unionByName(border)
    return (everything.join(lab.select(F.col("_id").alias(id_col), F.col("label").alias("_label")), id_col, "left")
            .withColumn(out, F.coalesce(F.col("_label"), F.lit(-1)).cast("long")).drop("_label"))


def dbscan_wide(df: DataFrame, id_col: str, cols, eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES,
                out: str = "cluster", cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """``dbscan`` for any number of columns: an eps-join over cells around pivots, occupied cells only.

    Equal points are one point with a weight. A point asks its nearest cell first. Where
    that shows too few neighbours, it meets all cells that can hold a point within eps of
    it (triangle inequality); blocks of them give counts, forests of links and smallest
    labels, never pairs. Links between clusters found so far need one side to ask: first
    a few points of each, then all points outside the largest one that did not ask yet.
    Ids are distinct numbers.
    """
    cols = list(cols)
    rows = pivots.nulls_out(df.select(F.col(id_col).alias("_id"), *cols), cols)
    points = cut_lineage(rows.groupBy("_v").agg(F.min("_id").cast("long").alias("_id"), F.count("*").alias("weight")))
    n = points.count()
    if not n:
        return df.withColumn(out, F.lit(-1).cast("long"))
    near = pivots.WithinEps(points, eps, max(cell_rows, n // pivots.WIDE_CELLS))
    is_core = F.col("n") >= min_samples
    sure = cut_lineage(near.weights(near.points, max(1, min_samples)).where(is_core).select("_id"))
    unsure = near.points.join(sure, "_id", "left_anti")
    core_ids = cut_lineage(sure.unionByName(near.weights(unsure).where(is_core).select("_id")))
    core = cut_lineage(near.points.join(core_ids, "_id").withColumn("label", F.col("_id")))
    core = _relabel(core, near.links(core, core, 1))
    order = Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id")
    early = cut_lineage(core.withColumn("k", F.row_number().over(order)).where(F.col("k") <= DELEGATES).select("_id"))
    core = _relabel(core, near.links(core.join(early, "_id"), core))
    largest = core.groupBy("label").count().orderBy(F.desc("count"), "label").select("label").first()    # one row
    if largest:
        late = core.where(F.col("label") != largest[0]).join(early, "_id", "left_anti")
        core = _relabel(core, near.links(late, core))
    rest = near.points.join(core_ids, "_id", "left_anti")
    labels = core.select("_id", "label").unionByName(near.least_label(rest, core))
    labels = rows.select(F.col("_id").alias(id_col), "_v").join(
        points.select("_id", "_v").join(labels, "_id").select("_v", F.col("label").alias("_label")), "_v").select(id_col, "_label")
    return df.join(labels, id_col, "left").withColumn(out, F.coalesce("_label", F.lit(-1)).cast("long")).drop("_label")


def _relabel(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The points with the smallest label that edges (u, v) of labels link to theirs."""
    found = components(edges).select(F.col("node").alias("label"), "component")
    return cut_lineage(points.join(found, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component"))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest label of the node's component.

    Labels are unique per node, so the components are found on labels.
    """
    a = nodes.select(F.col("node").alias("src"), F.col("label").alias("u"))
    b = nodes.select(F.col("node").alias("dst"), F.col("label").alias("v"))
    found = components(edges.join(a, "src").join(b, "dst").select("u", "v"))
    found = found.select(F.col("node").alias("label"), "component")
    return cut_lineage(nodes.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("label")))


def agglomerative(df: DataFrame, cols, n_clusters: int = DEFAULT_K, out: str = "cluster", tail: int = WARD_TAIL,
                  cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """Exact Ward clustering into ``n_clusters``.

    Ward's cost is reducible, so merging clusters that are nearest to each other (by what
    the merge adds to the sum of squares), in any order, builds the same tree as merging
    the cheapest pair each time. Every round deals the clusters to cells around new pivots;
    a cell merges its pairs as long as no cluster of another cell can be as near to either
    (``_merge_in_cells``). Where that merges few, the mutual pairs of all cells are merged
    once (``_mutual``). The last ``tail`` clusters merge in one task. The tree
    is cut at its ``n_clusters`` - 1 dearest merges. Equal points start as one
    cluster. Clusters are numbered by their smallest point, coordinate by coordinate;
    rows with a missing feature keep a NULL label. Ties go to the smaller point.
    """
    cols = list(cols)
    rows = pivots.nulls_out(df, cols)
    start = rows.groupBy("_v").agg(F.count("*").cast("double").alias("w"))
    start = cut_lineage(start.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_id", F.monotonically_increasing_id()))
    state, merges, left, turn = start.select("_id", "_v", "w"), [], start.count(), 0
    while left > max(tail, 1):
        turn += 1
        done = _merge_in_cells(state, WARD_CELLS * cell_rows, turn)
        state, before = done.where("b IS NULL").select("_id", "_v", "w"), left
        merges.append(done.where("b IS NOT NULL").select(F.col("_id").alias("a"), "b", "cost"))
        left = state.count()
        if left <= max(tail, WARD_STALL * before):
            continue
        pairs = cut_lineage(_mutual(state, cell_rows))
        a, b = (state.select(F.col("_id").alias(i), F.col("_v").alias(f"v{i}"), F.col("w").alias(f"w{i}")) for i in "ab")
        both = pairs.join(a, "a").join(b, "b")
        v = F.zip_with("va", "vb", lambda x, y: (x * F.col("wa") + y * F.col("wb")) / (F.col("wa") + F.col("wb")))
        merged = both.select(F.col("a").alias("_id"), v.alias("_v"), (F.col("wa") + F.col("wb")).alias("w"))
        gone = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
        state = cut_lineage(state.join(gone, "_id", "left_anti").unionByName(merged))
        merges.append(pairs)
        left = state.count()
    last = state.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_ward_tail, "a long, b long, cost double")     # tail rows at most
    merges = cut_lineage(functools.reduce(DataFrame.unionByName, merges, last))
    cut = merges.orderBy(F.desc("cost"), F.desc("a"), F.desc("b")).limit(max(0, n_clusters - 1))
    kept = merges.join(cut.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(kept).select(F.col("node").alias("_id"), "component")
    labels = cut_lineage(start.join(found, "_id", "left").select("_v", F.coalesce("component", "_id").alias("_c")))
    # n_clusters rows at most
    order = Window.orderBy("_c")
    number = labels.select("_c").distinct().withColumn(out, (F.row_number().over(order) - 1).cast("int"))
    labels = labels.join(number, "_c").select("_v", out)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn("_v", vec).join(labels, "_v", "left").drop("_v")


def _merge_in_cells(state: DataFrame, cell_rows: int, turn: int) -> DataFrame:
    """(_id, _v, w, b, cost): the merges (_id, b, cost) that cells can make by themselves, and the clusters left (b NULL).

    Cells are convex, so a merged cluster stays in its cell, and weights only grow: what a
    cell knows of the others at first (``pivots.Outside``, their least weights) bounds the
    cost of merging with any of their clusters from below whatever they merge meanwhile.
    """
    cells = pivots.choose(state, cell_rows=cell_rows, seed=turn)
    placed = cut_lineage(pivots.with_cells(state, cells))
    stats = placed.groupBy("_cell").agg(F.max("_far").alias("far"), F.min("w").alias("least")).orderBy("_cell").toArrow()   # PIVOTS squared rows at most
    occupied, far, least = (stats.column(c).to_numpy() for c in ("_cell", "far", "least"))
    shared = state.sparkSession.sparkContext.broadcast((cells, occupied, far, least))

    def run(table: pa.Table) -> pa.Table:
        cells, occupied, far, least = shared.value
        cell = table.column("_cell")[0].as_py()
        outside = pivots.Outside(cells, cell, occupied, far)
        return _ward_cell(table, outside, least[outside.at])

    return cut_lineage(placed.groupBy("_cell").applyInArrow(run, "_id long, _v array<double>, w double, b long, cost double"))


def _ward_cell(table: pa.Table, outside: pivots.Outside, least: np.ndarray) -> pa.Table:
    """Merges along chains of nearest clusters, each cheaper than any merge of the two with the cells ``outside``.

    Where a cluster may be nearer to another cell, it waits, and so do those it is nearest to.
    """
    ids, v, w = table.column("_id").to_numpy().copy(), pivots.matrix(table.column("_v")).copy(), table.column("w").to_numpy().copy()

    def bound(v, w):
        d = outside.distances(v)
        return (least * w[:, None] / (least + w[:, None]) * d * d).min(1, initial=np.inf) * (1 - pivots.SLACK)

    step = max(1, pivots.MEETING // max(1, len(least)))
    out = np.concatenate([bound(v[lo:lo + step], w[lo:lo + step]) for lo in range(0, len(v), step)])
    alive, waits, merges = np.ones(len(v), bool), np.zeros(len(v), bool), []
    todo, chain = np.argsort(-ids).tolist(), []
    while todo or chain:
        if not chain:
            k = todo.pop()
            if not alive[k] or waits[k]:
                continue
            chain.append(k)
        if 2 * alive.sum() < len(alive) and len(alive) > 64:     # the merged ones leave
            new = np.cumsum(alive) - 1
            todo, chain = [int(new[k]) for k in todo if alive[k]], [int(new[k]) for k in chain]
            ids, v, w, out, waits = ids[alive], v[alive], w[alive], out[alive], waits[alive]
            alive = np.ones(len(v), bool)
        k = chain[-1]
        cost = w[k] * w / (w[k] + w) * pivots.squares(v[k:k + 1], v)[0]
        cost[~alive] = np.inf
        cost[k] = np.inf
        low = cost.min()
        if waits[k] or not low < out[k]:
            waits[chain] = True
            chain = []
            continue
        at = np.flatnonzero(cost == low)
        j = int(at[0]) if len(at) == 1 else int(at[np.lexsort((np.maximum(ids[at], ids[k]), np.minimum(ids[at], ids[k])))[0]])
        if len(chain) > 1 and cost[chain[-2]] == low:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        merges.append((int(min(ids[j], ids[k])), int(max(ids[j], ids[k])), float(low)))
        v[j] = (w[j] * v[j] + w[k] * v[k]) / (w[j] + w[k])
        w[j], ids[j], alive[k] = w[j] + w[k], min(ids[j], ids[k]), False
        out[j] = bound(v[j:j + 1], w[j:j + 1])[0]
        chain = chain[:-2]
        todo.append(j)
    none = [None] * len(merges)
    a, b, costs = ([r[k] for r in merges] for k in range(3))
    lost = [None] * int(alive.sum())
    return pa.table({"_id": pa.array(ids[alive].tolist() + a, pa.int64()), "_v": pa.array(v[alive].tolist() + none, pa.list_(pa.float64())),
                     "w": pa.array(w[alive].tolist() + none, pa.float64()), "b": pa.array(lost + b, pa.int64()),
                     "cost": pa.array(lost + costs, pa.float64())})


def _mutual(state: DataFrame, cell_rows: int) -> DataFrame:
    """(a, b, cost) with a < b of the clusters (_id, _v, w) that are each other's nearest."""
    cells = pivots.choose(state, cell_rows=cell_rows)
    placed = cut_lineage(pivots.with_cells(state, cells))
    stats = cut_lineage(pivots.spread(placed, []))
    least = placed.agg(F.min("w")).first()[0]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            x, y = pivots.matrix(a.column("_v")), pivots.matrix(b.column("_v"))
            i, j = a.column("_id").to_numpy(), b.column("_id").to_numpy()
            wi, wj = a.column("w").to_numpy()[:, None], b.column("w").to_numpy()[None, :]
            cost = wi * wj / (wi + wj) * pivots.squares(x, y)
            cost[i[:, None] == j[None, :]] = np.inf
            low = cost.min(1)
            lo, hi = np.minimum(i[:, None], j[None, :]), np.maximum(i[:, None], j[None, :])
            for k in np.flatnonzero(np.isfinite(low)):
                at = np.flatnonzero(cost[k] == low[k])
                at = at[np.lexsort((hi[k, at], lo[k, at]))[0]]
                out.append((int(i[k]), int(j[at]), float(low[k])))
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(
            (("_id", pa.int64()), ("o", pa.int64()), ("cost", pa.float64())))})

    search = lambda met: pivots.met_in_blocks(met, placed, stats, [], ["_id", "_v", "w"], ["_id", "_v", "w"], best,
                                              "_id long, o long, cost double")
    nearest = lambda d: d.groupBy("_id").agg(F.min(F.struct(
        "cost", F.least("_id", "o").alias("a"), F.greatest("_id", "o").alias("b"))).alias("n"))
    home = cut_lineage(pivots.meetings(state, cells, stats, [], np.inf, enough=2))
    first = cut_lineage(search(home))
    # A cluster of weight w at distance d costs at least least * w / (least + w) * d * d.
    reach = nearest(first).select("_id", F.col("n.cost").alias("c"))
    wider = state.join(reach, "_id", "left").withColumn("_reach", F.sqrt(
        F.coalesce("c", F.lit(float("inf"))) * (F.lit(least) + F.col("w")) / (F.lit(least) * F.col("w"))) * (1 + pivots.SLACK)).drop("c")
    rest = pivots.meetings(wider, cells, stats, [], np.inf).join(home.select("_id", "_cell"), ["_id", "_cell"], "left_anti")
    found = nearest(first.unionByName(search(cut_lineage(rest.drop("_reach"))))).select("n.a", "n.b", "n.cost")
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("cost").alias("cost")).where("n = 2").select("a", "b", "cost")


def _ward_tail(table: pa.Table) -> pa.Table:
    """All merges (a, b, cost) of a bounded number of clusters, along chains of nearest ones."""
    ids, v = table.column("_id").to_numpy().copy(), pivots.matrix(table.column("_v")).copy()
    w, alive, out, chain = table.column("w").to_numpy().copy(), np.ones(table.num_rows, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[np.argmin(ids[alive])]))
        k = chain[-1]
        cost = w[k] * w / (w[k] + w) * pivots.squares(v[k:k + 1], v)[0]
        cost[~alive] = np.inf
        cost[k] = np.inf
        at = np.flatnonzero(cost == cost.min())
        j = int(at[np.lexsort((np.maximum(ids[at], ids[k]), np.minimum(ids[at], ids[k])))[0]])
        if len(chain) > 1 and cost[chain[-2]] == cost[j]:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        out.append((int(min(ids[j], ids[k])), int(max(ids[j], ids[k])), float(cost[j])))
        v[j] = (w[j] * v[j] + w[k] * v[k]) / (w[j] + w[k])
        w[j], ids[j], alive[k] = w[j] + w[k], min(ids[j], ids[k]), False
        chain = chain[:-2]
    return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(
        (("a", pa.int64()), ("b", pa.int64()), ("cost", pa.float64())))})
