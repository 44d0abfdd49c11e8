"""Random forest and boosted regression over sums per cell of binned features, for many rows.

MLlib's forest keeps each row with one bootstrap count per tree and reads all rows
for every level. Its trees only ever see binned features, so a tree needs no more of
the rows than the sums of w, w * y and w * y^2 (w: the row's bootstrap count) of each
combination of bins, a cell. Here every row is counted once into its cell, for all
trees; each tree is then MLlib's own, fitted to its cells as two weighted points
mean - deviation and mean + deviation, which have the cell's three sums. The work
after the one pass over the rows grows with the cells, at most 32 per feature
multiplied, and not with the rows.

Boosted trees draw no rows, and what earlier trees predict is one number for a cell, so
the residuals of its two points keep the sums of its rows' residuals: MLlib's boosting on
the points builds the trees that it builds on the binned rows.
"""

from __future__ import annotations

import math
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import cut_lineage, ensure_checkpoint_dir

MAX_BINS = 32              # MLlib's default
MAX_CELLS = 1 << 20        # four features of 32 bins
SUMS_FROM = 1 << 27        # bootstrap counts (rows * trees) up to which MLlib holds them itself
TASK_POINTS = 1 << 16      # points of cells that a task of the boosting reads
_SUMS = "_cell long, _w double, _wy double, _wyy double"


def bin_edges(df: DataFrame, cols) -> list[list[float]]:
    """Per column the inner edges of at most 32 bins, over all rows.

    Up to 32 distinct values have a bin each, with edges half-way between them (as in
    MLlib); others are cut at quantiles. A value on an edge belongs to the bin above.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.approx_count_distinct(x[c]).alias(f"d{i}"), F.min(x[c]).alias(f"m{i}"),
        F.percentile_approx(x[c], probs, 1000).alias(f"q{i}"))]).first()
    few = [i for i in range(len(cols)) if row[f"d{i}"] <= 2 * MAX_BINS]
    sets = df.agg(*[F.collect_set(x[cols[i]]).alias(f"v{i}") for i in few]).first() if few else {}
    edges = []
    for i in range(len(cols)):
        values = sorted(sets[f"v{i}"]) if i in few else []
        if i in few and len(values) <= MAX_BINS:
            e = [(a + b) / 2 for a, b in zip(values, values[1:])]
        else:
            e = sorted({q for q in row[f"q{i}"] or [] if q > row[f"m{i}"]})
        e = sorted({v for v in e if math.isfinite(v)})
        edges.append(e or [0.0])       # a bucketizer needs an edge, also for a constant
    return edges


def n_cells(edges) -> int:
    return math.prod(len(e) + 1 for e in edges)


def _strides(edges) -> list[int]:
    return [math.prod(len(e) + 1 for e in edges[:i]) for i in range(len(edges))]


def _binned(cols, edges) -> tuple[list[str], Bucketizer, VectorAssembler]:
    """The names of the columns' bins, and the stages that make them and their vector ``_bins``."""
    buckets = [f"_b{i}" for i in range(len(cols))]
    bucketizer = Bucketizer(splitsArray=[[-math.inf, *e, math.inf] for e in edges],
                            inputCols=list(cols), outputCols=buckets)
    return buckets, bucketizer, VectorAssembler(inputCols=buckets, outputCol="_bins")


def _checked_label() -> Column:
    return F.when(F.isnan("_label"), F.raise_error(F.lit("a label is NaN"))).otherwise(F.col("_label"))


def _all_points(edges) -> int:
    """``maxBins`` with which MLlib looks for split points in every point: its sample is of max_bins^2 rows."""
    return max(MAX_BINS, math.isqrt(2 * n_cells(edges)) + 1)


def cell_sums(df: DataFrame, buckets, edges, n_trees: int, seed: int) -> DataFrame:
    """(_tree, _cell, _w, _wy, _wyy): each tree's bootstrap sums of ``_label`` over the rows of a cell.

    Every row counts a Poisson(1) number of times in every tree; k equal rows together
    count Poisson(k) times. Cells with many labels are dealt over several tasks.
    """
    cell = sum(F.col(b).cast("long") * s for b, s in zip(buckets, _strides(edges)))
    points = df.select(cell.alias("_cell"), "_label").groupBy("_cell", "_label").agg(F.count(F.lit(1)).alias("_k"))
    points = points.repartitionByRange("_cell", "_label").sortWithinPartitions("_cell", "_label")

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        tree = np.arange(n_trees, dtype=np.int32)

        def rows(cells, sums):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.tile(tree, len(cells))), pa.array(np.repeat(cells, n_trees)),
                 *[pa.array(s.ravel()) for s in sums]], names=["_tree", "_cell", "_w", "_wy", "_wyy"])

        last, kept = None, None        # the cell that the next batch may go on with, and its sums
        for b in batches:
            if not b.num_rows:
                continue
            c, y, k = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            w = rng.poisson(1.0, (len(c), n_trees))
            more = np.flatnonzero(k > 1)
            w[more] += rng.poisson((k[more] - 1)[:, None], (len(more), n_trees))
            w = w.astype(float)
            at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            sums = [np.add.reduceat(v, at, axis=0) for v in (w, w * y[:, None], w * (y * y)[:, None])]
            cells = c[at]
            if last is not None:
                if last == cells[0]:
                    for s, old in zip(sums, kept):
                        s[0] += old[0]
                else:
                    yield rows(np.array([last]), kept)
            last, kept = cells[-1], [s[-1:].copy() for s in sums]
            if len(cells) > 1:
                yield rows(cells[:-1], [s[:-1] for s in sums])
        if last is not None:
            yield rows(np.array([last]), kept)

    return (points.mapInArrow(draw, f"_tree int, {_SUMS}").where("_w > 0").repartition(n_trees, "_tree")
            .groupBy("_tree", "_cell").agg(*[F.sum(v).alias(v) for v in ("_w", "_wy", "_wyy")]))


def fit_forest(df: DataFrame, cols, edges, n_trees: int, max_depth: int, seed: int) -> PipelineModel:
    """Forest on the numeric columns ``cols`` and ``_label`` as a pipeline: bins, trees, mean of the trees."""
    spark = df.sparkSession
    buckets, bucketizer, bins = _binned(cols, edges)
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    seeds = np.random.default_rng(seed).integers(2 ** 31, size=n_trees)

    def fit_tree(t):
        d = spark.read.schema(_SUMS).parquet(f"{path}/_tree={t}")
        m = F.col("_wy") / F.col("_w")
        s = F.sqrt(F.greatest(F.col("_wyy") / F.col("_w") - m * m, F.lit(0.0)))
        d = d.select(*[((F.col("_cell") / F.lit(k)).cast("long") % (len(e) + 1)).cast("double").alias(b)
                       for b, k, e in zip(buckets, _strides(edges), edges)],
                     F.explode(F.array(m - s, m + s)).alias("_label"), (F.col("_w") / 2).alias("_weight"))
        return RandomForestRegressor(
            featuresCol="_bins", labelCol="_label", weightCol="_weight", predictionCol=f"_p{t}", numTrees=1,
            bootstrap=False, maxDepth=max_depth, seed=int(seeds[t]),
            featureSubsetStrategy="onethird" if n_trees > 1 else "all",
            maxBins=_all_points(edges)).fit(bins.transform(d))

    try:
        sums = cell_sums(bucketizer.transform(df.withColumn("_label", _checked_label())), buckets, edges, n_trees, seed)
        sums.write.partitionBy("_tree").parquet(path)
        with ThreadPool(8) as pool:
            trees = pool.map(inheritable_thread_target(spark)(fit_tree), range(n_trees))
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    mean = SQLTransformer(statement="SELECT *, ({}) / {} AS prediction FROM __THIS__".format(
        " + ".join(f"_p{t}" for t in range(n_trees)), n_trees))
    return PipelineModel([bucketizer, bins, *trees, mean])


def cell_points(df: DataFrame, buckets) -> DataFrame:
    """(bins..., _label, _weight): two points for every filled cell, with its rows' number, mean and deviation of ``_label``."""
    m, s = F.col("_m"), F.col("_s")
    # as int, as the bucketizer marks its columns as categories, which MLlib would split in any order
    cells = df.groupBy(*[F.col(b).cast("int").alias(b) for b in buckets]).agg(F.count(F.lit(1)).alias("_n"), F.avg("_label").alias("_m"), F.stddev_pop("_label").alias("_s"))
    return cells.select(*buckets, F.explode(F.array(m - s, m + s)).alias("_label"), (F.col("_n") / 2).alias("_weight"))


def fit_boosted(df: DataFrame, cols, edges, n_trees: int, step: float, max_depth: int, seed: int) -> PipelineModel:
    """Boosted trees on the numeric columns ``cols`` and ``_label`` as a pipeline: bins, trees."""
    buckets, bucketizer, bins = _binned(cols, edges)
    points = cut_lineage(cell_points(bucketizer.transform(df.withColumn("_label", _checked_label())), buckets))
    points = bins.transform(points.repartition(-(-points.count() // TASK_POINTS) or 1))
    trees = GBTRegressor(featuresCol="_bins", labelCol="_label", weightCol="_weight", maxIter=n_trees, stepSize=step,
                         maxDepth=max_depth, seed=seed, maxBins=_all_points(edges)).fit(points)
    return PipelineModel([bucketizer, bins, trees])
