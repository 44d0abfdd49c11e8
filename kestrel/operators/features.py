"""Feature selection (ANOVA F k-best, variance threshold, PCA) and class
balancing (random undersampling, SMOTE).

Every fit is one aggregation whose result is bounded by the number of
features (or classes); transforms are projections with literal coefficients.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import numeric_columns, stats_row


# A class target is discrete; its classes come to the driver as one small row each.
MAX_CLASSES = 100_000


# ------------------------------------------------------------- selection

def anova_f(df: DataFrame, target: str, cols=None) -> DataFrame:
    """ANOVA F statistic of every numeric feature against a discrete target.

    F = [SSB / (k - 1)] / [SSW / (n - k)] from per-class count, mean and
    population variance, each over the rows where the feature and the target
    are known; two aggregations, the second over one row per class.
    Output (feature, f_score); constant features give NULL.
    """
    cols = [c for c in (cols or numeric_columns(df, exclude=[target])) if c != target]
    x = {c: F.col(c).cast("double") for c in cols}
    per = df.where(F.col(target).isNotNull()).groupBy(target).agg(*[e for c in cols for e in (
        F.count(x[c]).alias(f"n_{c}"), F.avg(x[c]).alias(f"m_{c}"), F.var_pop(x[c]).alias(f"v_{c}"))])
    exprs = []
    for c in cols:
        n, m, v = F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"v_{c}")
        total, k = F.sum(n), F.count_if(n > 0)
        # sum n (m - g)^2 = sum n m^2 - (sum n m)^2 / sum n
        ssb = F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / total
        ssw = F.sum(n * v)
        exprs.append(F.struct(F.lit(c).alias("feature"), F.when(
            (ssw > 0) & (k > 1) & (total > k), (ssb / (k - 1)) / (ssw / (total - k))).alias("f_score")))
    return per.agg(F.array(*exprs).alias("_a")).select(F.explode("_a").alias("s")).select("s.*")


def kbest_scores(df: DataFrame, target: str, k: int = 5, cols=None) -> DataFrame:
    """(feature, f_score, rank, selected): the k highest F scores are selected."""
    sc = anova_f(df, target, cols)
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))
    return (sc.withColumn("rank", F.row_number().over(w))  # one row per feature
            .withColumn("selected", F.col("rank") <= k))


def select_kbest(df: DataFrame, target: str, k: int = 5, cols=None) -> DataFrame:
    """Keep the k best features (original order) and append the target."""
    sel = {r["feature"] for r in kbest_scores(df, target, k, cols).where("selected").collect()}
    keep = [c for c in df.columns if c in sel]
    return df.select(*keep, target)


def variance_threshold(df: DataFrame, threshold: float = 0.0, cols=None) -> DataFrame:
    """Keep numeric columns whose population variance exceeds ``threshold``;
    non-numeric columns are dropped."""
    cols = list(cols or numeric_columns(df))
    v = stats_row(df, {c: F.var_pop(F.col(c).cast("double")) for c in cols})
    return df.select(*[c for c in cols if v[c] is not None and v[c] > threshold])


# ------------------------------------------------------------------- PCA

def fit_pca(df: DataFrame, cols, k: int) -> dict:
    """Means and the top-k eigenvectors of the covariance matrix.

    The d x d covariance comes from one aggregation (sums of products, d is
    the number of features); the eigen-decomposition runs on that small
    matrix. Sign rule: the largest absolute loading of a component is positive.
    """
    cols = list(cols)
    d = len(cols)
    if k > d:
        raise ValueError("k must not exceed the number of columns")
    x = [F.col(c).cast("double") for c in cols]
    exprs = {f"m{i}": F.avg(x[i]) for i in range(d)}
    exprs.update({f"c{i}_{j}": F.covar_samp(x[i], x[j]) for i in range(d) for j in range(i, d)})
    exprs["n"] = F.count(F.lit(1))
    r = stats_row(df.na.drop(subset=cols), exprs)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    comps = vecs[:, order].T
    for i in range(k):
        if comps[i][np.argmax(np.abs(comps[i]))] < 0:
            comps[i] = -comps[i]
    return {"cols": cols, "mean": [r[f"m{i}"] for i in range(d)], "components": comps.tolist(),
            "explained_variance": vals[order].tolist()}


def pca(df: DataFrame, cols=None, k: int = 2, params: dict | None = None, keep=()) -> DataFrame:
    """Centred projection onto ``PCA_1..PCA_k``; other columns dropped
    (except ``keep``). Rows with a NULL feature are dropped."""
    cols = list(cols or numeric_columns(df))
    p = params or fit_pca(df, cols, k)
    d = df.na.drop(subset=cols)
    proj = [sum((F.col(c).cast("double") - F.lit(p["mean"][j])) * F.lit(float(p["components"][i][j]))
                for j, c in enumerate(cols)).alias(f"PCA_{i + 1}") for i in range(k)]
    return d.select(*keep, *proj)


def pca_projection(df: DataFrame, cols, cluster_col: str) -> DataFrame:
    """Two principal components plus the cluster column (for display)."""
    return pca(df, cols, 2, keep=[cluster_col])


# -------------------------------------------------------------- balancing

_U52 = float(16 ** 13)
MAX_TRIES = 8       # widenings of the bands before giving up; each is four times as wide


def hash_uniform(seed: int, cols) -> "F.Column":
    """Uniform value in [0, 1) from 52 bits of the MD5 of the seed and the row key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(_U52)


def mark_k_smallest(df: DataFrame, group: str | None, u: str, k_of: dict, tie_cols, counts: dict,
                    out: str = "_in") -> DataFrame:
    """Every row with a flag: whether its ``u`` is among the k_g smallest of its group g (exact).

    ``u`` is uniform on [0, 1), so the k-th smallest of n values lies within
    a few sqrt(k) / n of k / n. Band [lo, hi] per group is verified by counts
    (widened and retried if ever needed); only rows inside the band are ranked,
    which gives each group's k-th value. Every row is then decided by a comparison
    with it, where it stands: the table of groups is sent to the rows. Only rows
    equal to a k-th value that they share go by ``tie_cols``, then by all columns,
    so rows that differ are decided alike on every evaluation.
    """
    spark = df.sparkSession
    width = 8.0
    gtype = df.schema[group].dataType.simpleString() if group else "int"

    groups = list(counts)       # a group goes by its place here, as NULL and NaN do too

    def beside(rows: list, cols: list[str]) -> DataFrame:
        """The rows with their group's place ``_i`` and values: literals of the one group, or a small table."""
        if not group:
            return df.select("*", F.lit(0).alias("_i"), *[F.lit(v).alias(c) for c, v in zip(cols, rows[0])])
        kinds = ", ".join(f"{c} {'long' if c == '_need' else 'double'}" for c in cols)
        table = spark.createDataFrame([((g,), i, *rows[i]) for i, g in enumerate(groups)], f"_gk struct<g:{gtype}>, _i int, {kinds}")
        return df.withColumn("_gk", F.struct(F.col(group).alias("g"))).join(F.broadcast(table), "_gk").drop("_gk")

    size = [(n, min(n, max(0, k_of.get(g, 0)))) for g, n in counts.items()]
    part = [i for i, (n, k) in enumerate(size) if 0 < k < n]       # the others are in or out as a whole
    for _ in range(MAX_TRIES):
        bands = [_band(n, k, width) if 0 < k < n else (2.0, 2.0) for n, k in size]
        d = beside(bands, ["_lo", "_hi"])
        inside = (F.col(u) >= F.col("_lo")) & (F.col(u) <= F.col("_hi"))
        st = {r["_i"]: r for r in d.groupBy("_i").agg(
            F.count_if(F.col(u) < F.col("_lo")).alias("below"), F.count_if(inside).alias("inband")).collect()} if part else {}
        if all(st[i].below <= size[i][1] <= st[i].below + st[i].inband for i in part):
            break
        width *= 4
    else:
        raise RuntimeError("no band holds the k-th smallest value")
    # per group: the k-th value, and how many of the rows that have it are among the k; -1: all of them
    cuts = [(2.0 if k >= n else -1.0, -1) for n, k in size]
    if part:
        left = {i: size[i][1] - st[i].below for i in part}
        for i in part:
            cuts[i] = (bands[i][0], 0)      # stands if all k are below the band
        before = Window.partitionBy("_i").orderBy(u).rowsBetween(Window.unboundedPreceding, -1)
        per = d.where(inside).groupBy("_i", u).agg(F.count(F.lit(1)).alias("_n"))
        per = per.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        need = spark.createDataFrame(list(left.items()), "_i int, _left long")
        kth = per.join(F.broadcast(need), "_i").where((F.col("_b") < F.col("_left")) & (F.col("_left") <= F.col("_b") + F.col("_n")))
        for r in kth.collect():             # one row a group
            cuts[r["_i"]] = (r[u], -1 if r["_left"] == r["_b"] + r["_n"] else r["_left"] - r["_b"])
    d = beside(cuts, ["_cut", "_need"])
    if all(n < 0 for _, n in cuts):
        return d.select(*df.columns, (F.col(u) <= F.col("_cut")).alias(out))
    tied = (F.col(u) == F.col("_cut")) & (F.col("_need") >= 0)
    w = Window.partitionBy("_i").orderBy(*[F.col(c) for c in tie_cols], F.xxhash64(*[F.col(c) for c in df.columns]))
    ranked = d.where(tied).withColumn(out, F.row_number().over(w) <= F.col("_need"))
    rest = d.where(~tied).withColumn(out, F.col(u) <= F.col("_cut"))
    return ranked.select(*df.columns, out).unionByName(rest.select(*df.columns, out))


def _band(n: int, k: int, width: float) -> tuple[float, float]:
    s = width * math.sqrt(k) + 10
    return max(0.0, (k - s) / n), min(1.0, (k + s) / n)


def class_counts(df: DataFrame, col: str) -> dict:
    """{class: rows}, NULL included: one row per class; at most MAX_CLASSES classes."""
    rows = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{col} has more than {MAX_CLASSES} classes")
    return {r[col]: r["n"] for r in rows}


def _lookup(group: str, mapping: dict):
    """CASE expression group -> value for a small per-class table."""
    e = F.lit(None).cast("double")
    for g, v in mapping.items():
        e = F.when(F.col(group) == F.lit(g), F.lit(v)).otherwise(e)
    return e


def random_undersample(df: DataFrame, target: str, seed: int = 42, key_cols=None) -> DataFrame:
    """Cut every class to the size of the smallest class, without replacement.

    Rows are chosen by a seeded hash of ``key_cols`` (all columns by default),
    so the result is repeatable and independent of partitioning. Rows without a
    class belong to none and are left out.
    """
    key_cols = list(key_cols or df.columns)
    known = df.where(F.col(target).isNotNull())
    counts = class_counts(known, target)
    n_min = min(counts.values(), default=0)
    d = known.withColumn("_u", hash_uniform(seed, key_cols))
    return mark_k_smallest(d, target, "_u", {g: n_min for g in counts}, key_cols, counts).where("_in").drop("_u", "_in")


def smote(df: DataFrame, target: str, cols, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Grow every smaller class to the size of the largest with synthetic rows
    x + u * (x_nn - x), x_nn one of the k nearest same-class rows (exact grid
    kNN). Returns (target, features..., synthetic) with the original rows kept.

    Sample j of class c takes base point floor(h1 * n_c) (by in-class position)
    and neighbour rank 1 + floor(h2 * k_c), with u = h3; h1..h3 are seeded
    hashes of (c, j), so the result is repeatable and computed on the cluster.
    """
    from ..ml.neighbors import knn
    from .position import global_position
    cols = list(cols)
    base = df.select(id_col, target, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    counts = class_counts(base, target)
    n_max = max(counts.values())
    need = {c: n_max - n for c, n in counts.items() if n < n_max and n >= 2}
    orig = base.select(target, *cols, F.lit(False).alias("synthetic"))
    if not need:
        return orig
    spark = df.sparkSession
    nb = knn(base, base, id_col, cols, k, exclude_self=True, by=[target])
    nb = nb.select(F.col(id_col).alias("_base"), F.col("_rank"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    pos = global_position(base.where(F.col(target).isin(list(need))), [target], [id_col])
    # one row per synthetic sample, generated on the cluster per class
    jobs = None
    for c, m in need.items():
        r = spark.range(m).select(F.lit(c).cast(base.schema[target].dataType).alias(target), F.col("id").alias("_j"))
        jobs = r if jobs is None else jobs.unionByName(r)
    kc = _lookup(target, {c: float(min(k, counts[c] - 1)) for c in need})
    nc = _lookup(target, {c: float(counts[c]) for c in need})

    def u(i):
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), F.col(target), F.col("_j")), 11).cast("double") / F.lit(float(2 ** 53))
    jobs = jobs.select(target, "_j", F.floor(u(1) * nc).cast("long").alias("_pos"),
                       (F.floor(u(2) * kc) + 1).cast("int").alias("_rank"), u(3).alias("_u"))
    s = (jobs.join(pos.select(target, "_pos", F.col(id_col).alias("_base"), *cols), [target, "_pos"])
         .join(nb, ["_base", "_rank"]))
    syn = s.select(target, *[(F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols],
                   F.lit(True).alias("synthetic"))
    return orig.unionByName(syn)
