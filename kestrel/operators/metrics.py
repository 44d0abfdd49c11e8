"""Classification, regression and clustering metrics over (y, prediction)
columns of a DataFrame.

Classification metrics come from one grouped count by (y, pred); AUC is the
exact rank-sum statistic with tie handling, computed from a score histogram
with distributed running counts; clustering metrics keep their per-cluster sums as a
table that is joined, and sum distances between cells where they need them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import MAX_LEVELS, stats_row
from ..ml import pivots
from ..session import cut_lineage
from .position import running_totals

NODES = 18              # Chebyshev nodes on each axis of a cell
APART = 2.0             # cells so many half widths apart meet by their nodes
FEW_COLUMNS = 3         # nodes grow with the power of the columns
CELLS_MET = 64          # cells, a side, that meet by their nodes in one group
TILE = 131_072          # distances that are summed at once

def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def _class_counts(df, y, pred):
    """Per class: tp, predicted, support; one scan, each (actual, predicted) pair counts once for either class."""
    pairs = df.groupBy(F.col(y).cast("string").alias("_y"), F.col(pred).cast("string").alias("_p")) \
              .agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    side = lambda c, support, predicted, tp: F.struct(
        F.col(c).alias("c"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(zero)
    both = pairs.select(F.explode(F.array(side("_y", F.col("_n"), zero, hit), side("_p", zero, F.col("_n"), zero))).alias("s"))
    return both.where("s.c IS NOT NULL").groupBy("s.c").agg(*[F.sum(f"s.{k}").alias(k) for k in ("support", "predicted", "tp")])


def _prf(c):
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.withColumns({"_pr": p, "_rc": r, "_f1": f})


def prf_weighted(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """precision, recall, f1 averaged with support weights (0 when undefined)."""
    c = _prf(_class_counts(df, y, pred))
    tot = F.sum("support")
    return c.agg((F.sum(F.col("_pr") * F.col("support")) / tot).alias("precision_weighted"),
                 (F.sum(F.col("_rc") * F.col("support")) / tot).alias("recall_weighted"),
                 (F.sum(F.col("_f1") * F.col("support")) / tot).alias("f1_weighted"))


def prf_binary(df: DataFrame, y: str = "y", pred: str = "pred", positive=1) -> DataFrame:
    """precision, recall, f1 of the positive class (0 when undefined)."""
    pos = F.lit(str(positive))
    yy, pp = F.col(y).cast("string") == pos, F.col(pred).cast("string") == pos
    s = df.agg(F.count_if(yy & pp).alias("tp"), F.count_if(pp).alias("predicted"),
               F.count_if(yy).alias("support"))
    return _prf(s).select(F.col("_pr").alias("precision_binary"), F.col("_rc").alias("recall_binary"),
                          F.col("_f1").alias("f1_binary"))


def _auc_by(df: DataFrame, keys, is_pos, score) -> DataFrame:
    """Exact AUC per key: P(score_pos > score_neg) + 0.5 P(equal); NULL where one side has no row."""
    keys = list(keys)
    hist = (df.select(*keys, is_pos.cast("int").alias("_pos"), score.cast("double").alias("_s"))
            .where(F.col("_s").isNotNull())
            .groupBy(*keys, "_s").agg(F.sum("_pos").alias("_np"),
                                      F.sum(1 - F.col("_pos")).alias("_nn")))
    rt = running_totals(hist, keys, "_s", ["_nn"])
    return rt.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_np") * (F.col("_nn_before") + 0.5 * F.col("_nn"))),
                     F.sum("_np") * F.sum("_nn")).alias("roc_auc"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", positive=1) -> DataFrame:
    """Binary ROC AUC of the score of the positive class (exact, ties averaged)."""
    return _auc_by(df, [], F.col(y).cast("string") == F.lit(str(positive)), F.col(score))


def roc_auc_ovr(df: DataFrame, y: str, score_cols: dict) -> DataFrame:
    """Multi-class one-vs-rest macro AUC; ``score_cols`` maps class -> score column."""
    long = df.select(F.col(y).cast("string").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(str(c)).alias("_cls"), F.col(s).cast("double").alias("_sc"))
        for c, s in score_cols.items()])).alias("_e")).select("_y", "_e.*")
    per = _auc_by(long, ["_cls"], F.col("_y") == F.col("_cls"), F.col("_sc"))
    return per.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred", labels=None) -> DataFrame:
    """Rows = actual label, one count column per predicted label (sorted)."""
    if labels is None:
        lv = (df.select(F.col(y).cast("string").alias("v")).union(df.select(F.col(pred).cast("string")))
              .where(F.col("v").isNotNull()).distinct().orderBy("v").limit(MAX_LEVELS + 1).collect())
        if len(lv) > MAX_LEVELS:
            raise ValueError("too many labels for a confusion matrix")
        labels = [r["v"] for r in lv]
    labels = [str(v) for v in labels]
    counts = (df.select(F.col(y).cast("string").alias("actual"), F.col(pred).cast("string").alias("_p"))
              .groupBy("actual").pivot("_p", labels).count())
    grid = df.sparkSession.createDataFrame([(v,) for v in labels], "actual string")
    out = grid.join(counts, "actual", "left").fillna(0, labels)
    return out.select("actual", *[F.col(v).cast("long").alias(f"pred_{v}") for v in labels])


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """r2, mae, mse, rmse in one aggregation."""
    e = F.col(y) - F.col(pred)
    return (df.agg(F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                   F.var_pop(F.col(y)).alias("_v"), F.count(F.lit(1)).alias("_n"))
            .select((1 - F.col("_sse") / (F.col("_v") * F.col("_n"))).alias("r2"), "mae", "mse",
                    F.sqrt("mse").alias("rmse")))


def mape(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """mean |(y - pred) / y| over rows with y != 0."""
    return df.where(F.col(y) != 0).agg(F.avg(F.abs((F.col(y) - F.col(pred)) / F.col(y))).alias("mape"))


# ----------------------------------------------------------- clustering

def _points(df: DataFrame, cols, cluster: str) -> DataFrame:
    """(_id, _c, _v, weight): the distinct points of every cluster. Rows with a missing feature or no cluster take no part."""
    rows = pivots.nulls_out(df.select(F.col(cluster).cast("string").alias("_c"), *cols).where("_c IS NOT NULL"), cols)
    found = rows.groupBy("_c", "_v").agg(F.count("*").alias("weight"))
    return cut_lineage(found.withColumn("_id", F.monotonically_increasing_id()))


def _clusters(points: DataFrame, d: int) -> DataFrame:
    """Per cluster: n, centroid and mean distance to it. A table, however many clusters there are."""
    sums = [F.sum(F.get("_v", F.lit(k)) * F.col("weight")) / F.sum("weight") for k in range(d)]
    mean = points.groupBy("_c").agg(F.sum("weight").alias("n"), F.array(*sums).alias("_mu"))
    far = F.sqrt(_square("_v", "_mu"))
    return cut_lineage(points.join(mean, "_c").groupBy("_c").agg(
        F.first("n").alias("n"), F.first("_mu").alias("_mu"), (F.sum(far * F.col("weight")) / F.first("n")).alias("s")))


def _square(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def _against_clusters(asking: DataFrame, clusters: DataFrame, fn, cols: list[str], schema: str) -> DataFrame:
    """``fn(asking, clusters, distances)`` for blocks of asking rows (_id, _c, _v, ...) and blocks of clusters."""
    members = clusters.select(F.lit(0).alias("_cell"), "_c", "n", "s", F.col("_mu").alias("_v"))
    stats = members.groupBy("_cell").agg(F.ceil(F.count("*") / F.lit(pivots.BLOCK)).cast("int").alias("blocks"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if a.num_rows and b.num_rows:
            rows = fn(a, b, np.sqrt(pivots.squares(pivots.matrix(a.column("_v")), pivots.matrix(b.column("_v")))))
        return pa.table(dict(zip(names, ([r[k] for r in rows] for k in range(len(names)))))).cast(kind)

    names = [x.split()[0] for x in schema.split(", ")]
    kind = asking.sparkSession.createDataFrame([], schema).limit(0).toArrow().schema
    return pivots.met_in_blocks(asking.withColumn("_cell", F.lit(0)), members, stats, [], cols, ["_c", "n", "s", "_v"], run, schema)


def _nodes(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Chebyshev nodes of a box on every axis; one where it has no width."""
    t = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    return [(a + b) / 2 + (b - a) / 2 * t if b > a else np.array([a]) for a, b in zip(lo, hi)]


def _grid(axes: list[np.ndarray]) -> np.ndarray:
    return np.stack([x.ravel() for x in np.meshgrid(*axes, indexing="ij")], 1)


def _shares(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The interpolation weights of a box's nodes at every row."""
    out = np.ones((len(x), 1))
    order = np.arange(NODES)
    at = np.cos(order[:, None] * (2 * order + 1) * np.pi / (2 * NODES)) * np.where(order == 0, 1.0, 2.0)[:, None] / NODES
    for k, (a, b) in enumerate(zip(lo, hi)):
        if b > a:
            angle = np.arccos(np.clip((2 * x[:, k] - a - b) / (b - a), -1.0, 1.0))
            out = (out[:, :, None] * (np.cos(angle[:, None] * order) @ at)[:, None, :]).reshape(len(x), -1)
    return out


def _slices(n: int, width: int, held: int):
    step = max(1, held // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, n, step))


def _distance_sums(asked: DataFrame, points: DataFrame, d: int, n: int, cell_rows: int | None = None) -> DataFrame:
    """(_id, o, total): the weighted distances of each asking point (_id, o) to all points of cluster o, in parts to be added.

    Points lie in cells around pivots. Where two cells are ``APART`` times their larger half
    width from each other, the distance is so smooth that its values between ``NODES``
    Chebyshev nodes on each axis give all others to within about 1e-13 of it: the members'
    weights go to their cell's nodes, sums are taken between nodes and read at the asking
    points. All other pairs, and groups with fewer points than nodes, are summed one by one.
    """
    if not n:
        return asked.sparkSession.createDataFrame([], "_id long, o string, total double")
    nodes = float(NODES) ** d
    if cell_rows is None:       # as much work between nodes as between points
        cell_rows = max(pivots.CELL_ROWS, math.ceil(n / max(1.0, (7.5 * n * n / nodes / nodes) ** (1 / 3)))) if d <= FEW_COLUMNS else max(n, 1)
    placed = cut_lineage(pivots.with_cells(points, pivots.choose(points, cell_rows=cell_rows)))
    asking = cut_lineage(asked.join(placed.select("_id", "_v", "_cell"), "_id"))
    ends = [f(F.get("_v", F.lit(k))) for f in (F.min, F.max) for k in range(d)]
    box = cut_lineage(placed.groupBy("_cell").agg(F.array(*ends[:d]).alias("lo"), F.array(*ends[d:]).alias("hi")))
    wide = F.aggregate(F.zip_with("lo", "hi", lambda x, y: F.when(y > x, float(NODES)).otherwise(1.0)), F.lit(1.0), lambda t, x: t * x)
    half = F.array_max(F.zip_with("lo", "hi", lambda x, y: (y - x) / 2))
    box = box.withColumn("nodes", wide).withColumn("half", half)
    side = lambda groups, i: groups.join(box, "_cell").select("o", *[F.col(c).alias(f"{i}_{c}") for c in ("_cell", "n", "lo", "hi", "nodes", "half")])
    t = side(asking.groupBy("o", "_cell").agg(F.count("*").alias("n")), "t")
    s = side(placed.groupBy(F.col("_c").alias("o"), "_cell").agg(F.count("*").alias("n")), "s")
    apart = lambda x, y: F.zip_with(x, y, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    gap = F.sqrt(F.aggregate(F.zip_with(apart("t_lo", "s_hi"), apart("s_lo", "t_hi"), lambda a, b: a * a + b * b), F.lit(0.0), lambda x, y: x + y))
    far = ~F.isnan(gap) & (gap > APART * F.greatest("t_half", "s_half")) & (F.col("t_n") > F.col("t_nodes")) & (F.col("s_n") > F.col("s_nodes"))
    pairs = cut_lineage(t.join(s, "o").select("o", "t__cell", "s__cell", far.alias("far")))

    near = pairs.where("NOT far").select("o", F.col("t__cell").alias("_cell"), F.col("s__cell").alias("s"))
    members = placed.select(F.col("_c").alias("o"), F.col("_cell").alias("s"), "_v", "weight").join(near, ["o", "s"]).drop("s")
    stats = members.groupBy("o", "_cell").agg(F.ceil(F.count("*") / F.lit(pivots.WIDE_BLOCK)).cast("int").alias("blocks"))

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        total = np.zeros(a.num_rows if b.num_rows else 0)
        if len(total):
            x, y, w = pivots.matrix(a.column("_v")), pivots.matrix(b.column("_v")), b.column("weight").to_numpy().astype(float)
            for k in _slices(len(x), len(y), TILE):
                total[k] = np.sqrt(pivots.squares(x[k], y)) @ w
        kept = a.slice(0, len(total))
        return pa.table({"_id": kept.column("_id"), "o": kept.column("o"), "total": total})

    found = pivots.met_in_blocks(asking, members, stats, ["o"], ["_id", "_v"], ["_v", "weight"], sums,
                                 "_id long, o string, total double", pivots.WIDE_BLOCK)
    return found.unionByName(_far_sums(asking, placed, box, pairs.where("far")))


def _far_sums(asking: DataFrame, placed: DataFrame, box: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_id, o, total) over pairs (o, t__cell, s__cell) of a cell's asking points and a far cell's members."""
    ends = box.select("_cell", "lo", "hi")
    row = lambda table, c: np.array(table.column(c)[0].as_py(), float)

    def gather(table: pa.Table) -> pa.Table:
        x, w, lo, hi = pivots.matrix(table.column("_v")), table.column("weight").to_numpy().astype(float), row(table, "lo"), row(table, "hi")
        at = sum(w[k] @ _shares(x[k], lo, hi) for k in _slices(len(x), len(_grid(_nodes(lo, hi))), pivots.MEETING))
        return table.slice(0, 1).select(["o", "_cell", "lo", "hi"]).append_column("sums", pa.array([at.tolist()], pa.list_(pa.float64())))

    kind = "o string, _cell long, lo array<double>, hi array<double>, sums array<double>"
    members = placed.select(F.col("_c").alias("o"), "_cell", "_v", "weight").join(
        pairs.select("o", F.col("s__cell").alias("_cell")).distinct(), ["o", "_cell"]).join(ends, "_cell")
    members = cut_lineage(members.groupBy("o", "_cell").applyInArrow(gather, kind))
    targets = pairs.groupBy("o", F.col("t__cell").alias("_cell")).agg(F.collect_list("s__cell").alias("others")).join(ends, "_cell")
    blocks = lambda d, c, n: d.withColumn(c, F.pmod(F.xxhash64("_cell"), F.col(n)).cast("int"))
    size = targets.groupBy("o").agg(F.ceil(F.count("*") / F.lit(CELLS_MET)).alias("ts")).join(
        members.groupBy("o").agg(F.ceil(F.count("*") / F.lit(CELLS_MET)).alias("ss")), "o")
    size = cut_lineage(size)
    left = blocks(targets.join(size, "o"), "_t", "ts").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("ss").cast("int") - 1)))
    right = blocks(members.join(size, "o"), "_s", "ss").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("ts").cast("int") - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = {r["_cell"]: (_grid(_nodes(r["lo"], r["hi"])), np.array(r["sums"])) for r in b.to_pylist()}
        out = []
        for r in a.to_pylist():
            own, values, hit = _grid(_nodes(r["lo"], r["hi"])), 0.0, False
            for o in sorted(r["others"]):
                if o in sides:
                    there, weights = sides[o]
                    values = values + np.concatenate([np.sqrt(pivots.squares(own[k], there)) @ weights for k in _slices(len(own), len(there), TILE)])
                    hit = True
            if hit:
                out.append((r["o"], r["_cell"], values.tolist()))
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(
            (("o", pa.string()), ("_cell", pa.int64()), ("part", pa.list_(pa.float64()))))})

    parts = left.select("o", "_t", "_s", "_cell", "lo", "hi", "others").groupBy("o", "_t", "_s").cogroup(
        right.select("o", "_t", "_s", "_cell", "lo", "hi", "sums").groupBy("o", "_t", "_s")).applyInArrow(meet, "o string, _cell long, part array<double>")
    values = parts.groupBy("o", "_cell").agg(F.collect_list("part").alias("parts"))      # a row for each CELLS_MET far cells
    values = cut_lineage(values.join(ends, "_cell"))

    def read(a: pa.Table, b: pa.Table) -> pa.Table:
        total = np.zeros(a.num_rows if b.num_rows else 0)
        if len(total):
            x, lo, hi = pivots.matrix(a.column("_v")), row(b, "lo"), row(b, "hi")
            values = np.array(b.column("parts")[0].as_py()).sum(0)
            for k in _slices(len(x), len(values), pivots.MEETING):
                total[k] = _shares(x[k], lo, hi) @ values
        kept = a.slice(0, len(total))
        return pa.table({"_id": kept.column("_id"), "o": kept.column("o"), "total": total})

    return asking.select("o", "_cell", "_id", "_v").groupBy("o", "_cell").cogroup(
        values.select("o", "_cell", "lo", "hi", "parts").groupBy("o", "_cell")).applyInArrow(read, "_id long, o string, total double")


def silhouette(df: DataFrame, cols, cluster: str, cell_rows: int | None = None) -> DataFrame:
    """Mean silhouette with Euclidean distances, over all points, to within rounding.

    The mean distance of x to a cluster is at least its distance to the centroid,
    and at most that plus the cluster's mean distance to its centroid. These bounds
    leave a point few clusters that can be its nearest other one; only for those
    and its own are distances summed (``_distance_sums``). Points of a one-point
    cluster score 0; with one cluster only there is no score.
    """
    cols = list(cols)
    points = _points(df, cols, cluster)
    clusters = _clusters(points, len(cols))

    def open_clusters(a, b, d):
        own, other, s = np.array(a.column("_c").to_pylist()), np.array(b.column("_c").to_pylist()), b.column("s").to_numpy()
        d = np.where(own[:, None] == other[None, :], np.inf, d)
        high = d + s
        i, j = np.nonzero((d <= high.min(1, keepdims=True) * (1 + 1e-9)) & np.isfinite(d))
        ids = a.column("_id").to_numpy()
        return list(zip(ids[i].tolist(), other[j].tolist(), d[i, j].tolist(), high[i, j].tolist()))

    bounds = _against_clusters(points, clusters, open_clusters, ["_id", "_c", "_v"], "_id bigint, o string, low double, high double")
    bounds = cut_lineage(bounds)
    least = bounds.groupBy("_id").agg((F.min("high") * (1 + 1e-9)).alias("least"))
    asked = bounds.join(least, "_id").where("low <= least").select("_id", "o")
    asked = asked.unionByName(points.select("_id", F.col("_c").alias("o")))
    found = _distance_sums(asked, points, len(cols), points.count(), cell_rows)
    found = found.groupBy("_id", "o").agg(F.sum("total").alias("total"))
    found = found.join(clusters.select(F.col("_c").alias("o"), "n"), "o").join(points.select("_id", "_c", "weight"), "_id")
    own = F.col("o") == F.col("_c")
    score = found.groupBy("_id").agg(
        F.first("weight").alias("weight"), F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0) \
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return score.agg((F.sum(s * F.col("weight")) / F.sum(F.when(s.isNotNull(), F.col("weight")))).alias("silhouette"))


def davies_bouldin(df: DataFrame, cols, cluster: str) -> DataFrame:
    """Mean over clusters of max_{j != i} (s_i + s_j) / d(mu_i, mu_j), with s
    the mean Euclidean distance of a cluster's points to its centroid."""
    cols = list(cols)
    clusters = _clusters(_points(df, cols, cluster), len(cols))
    asking = clusters.select("_c", F.col("_mu").alias("_v"), F.col("s").alias("_s"))

    def worst(a, b, d):
        own, other = np.array(a.column("_c").to_pylist()), np.array(b.column("_c").to_pylist())
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (a.column("_s").to_numpy()[:, None] + b.column("s").to_numpy()[None, :]) / d
        r = np.where(d == 0, np.inf, r)
        r = np.where(own[:, None] == other[None, :], 0.0, r)
        return list(zip(own.tolist(), r.max(1).tolist()))

    found = _against_clusters(asking, clusters, worst, ["_c", "_v", "_s"], "_c string, r double")
    return found.groupBy("_c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cols, cluster: str) -> DataFrame:
    """[tr(B) / (k - 1)] / [tr(W) / (n - k)] from per-cluster sums."""
    cols = list(cols)
    points = _points(df, cols, cluster)
    clusters = _clusters(points, len(cols))
    within = points.join(clusters.select("_c", "_mu"), "_c").agg(F.sum(_square("_v", "_mu") * F.col("weight")).alias("w"))
    whole = clusters.agg(*[(F.sum(F.get("_mu", F.lit(k)) * F.col("n")) / F.sum("n")).alias(f"m{k}") for k in range(len(cols))],
                         F.count("*").alias("k"), F.sum("n").alias("n")).first()     # one row
    mean = F.array(*[F.lit(whole[f"m{k}"]) for k in range(len(cols))])
    between = clusters.agg(F.sum(_square("_mu", mean) * F.col("n"))).first()[0]
    k, n = whole["k"], whole["n"] or 0
    ok = (F.col("w") > 0) & F.lit(k > 1 and n > k)
    return within.select(F.when(ok, F.lit((between or 0.0) / max(k - 1, 1)) / (F.col("w") / F.lit(max(n - k, 1))))
                         .alias("calinski_harabasz"))


def actual_vs_predicted(df: DataFrame, y: str = "y", pred: str = "pred", keep=()) -> DataFrame:
    return df.select(*keep, F.col(y).alias("actual"), F.col(pred).alias("predicted"))
