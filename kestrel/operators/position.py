"""Global row positions and bounded look-back ("halo") frames without
single-task windows.

A window ``partitionBy(series).orderBy(t)`` sends a whole series to one task.
For one very long series that does not scale, so positions are built in
steps that are all distributed:

1. rows are range-partitioned by (series, order columns, a hash of the row),
   sorted, numbered inside their partition and materialised once in the shared
   checkpoint folder, which fixes the partitioning; only rows that are equal in
   every column have to stay together;
2. rows per (series, partition) -> a small table -> cumulative offsets;
3. number inside the partition + offset = global position.

For frames that look back ``w`` rows, the last ``w`` rows of a partition are
copied into the following one(s) ("halo"), so that a window partitioned by
(series, partition) sees its full frame. Copies are at most ``w`` rows per
partition boundary.

NULL series keys form one series, NULL order values come first; no row is lost:
joins are on a struct of the keys, in which NULLs are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Number of range partitions; None: the session's spark.sql.shuffle.partitions,
# which a user sets in proportion to the data as for any other shuffle.
PARTITIONS: int | None = None


def _key(cols):
    """One join key of several columns, in which NULL equals NULL."""
    return F.struct(*[F.col(c) for c in cols])


def null_safe_join(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Join on columns of the same names where NULL equals NULL; the names come from ``left``."""
    cols = list(cols)
    r = right.withColumn("_jk", _key(cols)).drop(*cols)
    return left.withColumn("_jk", _key(cols)).join(r, "_jk", how).drop("_jk")


def _placed(df: DataFrame, series_cols, order_cols, partitions: int | None, pos: str):
    """Rows with ``pos`` and ``_bucket``, and the table (series, _bucket, _start, _cnt)."""
    from ..session import cut_lineage
    n = partitions or PARTITIONS
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    by = [*[F.col(c) for c in series_cols], *[F.col(c) for c in order_cols], row]
    d = df.repartitionByRange(n, *by) if n else df.repartitionByRange(*by)
    d = cut_lineage(d.sortWithinPartitions(*by).withColumn("_bucket", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    counts = d.groupBy(*series_cols, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    wc = Window.partitionBy(*series_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (series, partition)
    offsets = cut_lineage(counts.withColumn("_start", F.coalesce(F.sum("_cnt").over(wc), F.lit(0))))
    out = null_safe_join(d, offsets, [*series_cols, "_bucket"])
    return out.withColumn(pos, F.col("_start") + F.col("_mid") - F.col("_m0")).drop("_mid", "_m0"), offsets.drop("_m0")


def _names(c):
    return [c] if isinstance(c, str) else list(c)


def global_position(df: DataFrame, series_cols, order_cols, partitions: int | None = None,
                    pos: str = "_pos", keep_bucket: bool = False) -> DataFrame:
    """Add 0-based position of each row inside its series by ``order_cols``.

    Rows equal in ``order_cols`` are ordered by a hash of the whole row. Partition
    columns (``_bucket``, ``_start``, ``_cnt``) stay when ``keep_bucket``.
    """
    out, _ = _placed(df, list(series_cols), _names(order_cols), partitions, pos)
    return out if keep_bucket else out.drop("_bucket", "_start", "_cnt")


def halo_frame(df: DataFrame, series_cols, order_cols, lookback: int,
               partitions: int | None = None) -> DataFrame:
    """Rows with ``_pos``, ``_part`` (partition to compute in) and ``_halo`` flag.

    Each row appears once with ``_halo = false`` in its own partition, plus once
    with ``_halo = true`` in every later one whose first position is at most
    ``lookback`` rows after it. A window partitioned by (series, ``_part``)
    ordered by ``_pos`` then sees ``lookback`` predecessors for every own row.
    """
    series_cols = list(series_cols)
    p, counts = _placed(df, series_cols, _names(order_cols), partitions, "_pos")
    wn = Window.partitionBy(*series_cols).orderBy("_bucket").rowsBetween(1, max(1, lookback))
    nxt = counts.withColumn("_next", F.collect_list(F.struct("_bucket", "_start")).over(wn))
    nxt = nxt.select(*series_cols, "_bucket", F.filter(
        "_next", lambda t: t["_start"] - lookback <= F.col("_start") + F.col("_cnt") - 1).alias("_next"))
    # Few partitions have a successor within reach, and only their rows are looked at again.
    j = null_safe_join(p.drop("_start", "_cnt"), nxt, [*series_cols, "_bucket"])
    own = F.array(F.struct(F.col("_bucket").alias("_part"), F.lit(False).alias("_halo")))
    halo = F.transform(F.filter("_next", lambda t: t["_start"] - lookback <= F.col("_pos")),
                       lambda t: F.struct(t["_bucket"].alias("_part"), F.lit(True).alias("_halo")))
    return (j.select("*", F.explode(F.concat(own, halo)).alias("_ph"))
            .select(*[c for c in j.columns if c not in ("_next", "_bucket")], "_ph._part", "_ph._halo"))


def dense_index(values: DataFrame, col: str, out: str = "_idx") -> DataFrame:
    """0-based rank of each distinct value of ``col`` (any orderable type).

    Range-partitions the distinct values, materialises them in the shared
    checkpoint folder (so the partitioning is fixed), then adds per-partition
    offsets to the in-partition row index. No single task sees all values.
    """
    from ..session import cut_lineage
    d = values.select(col).distinct()
    d = cut_lineage(d.repartitionByRange(col).sortWithinPartitions(col)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    first = d.groupBy("_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the dictionary: a tiny window
    offs = first.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    return (d.join(F.broadcast(offs), "_pid")
            .select(col, (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(out)))


def running_totals(hist: DataFrame, keys, order_col: str, weights) -> DataFrame:
    """For every row of ``hist``: sums of ``weights`` over rows with the same
    ``keys`` and a smaller ``order_col`` (columns ``{w}_before``).

    ``hist`` is usually a histogram (one row per distinct value). It is
    range-partitioned on (keys, order_col) and materialised in the shared
    checkpoint folder; running sums are computed inside each range partition
    and partition offsets per key come from a table with one row per
    (partition, key). No task holds more than one range partition.
    """
    from ..session import cut_lineage
    keys = list(keys)
    weights = list(weights)
    h = cut_lineage(hist.repartitionByRange(*keys, order_col).withColumn("_pid", F.spark_partition_id()))
    per = h.groupBy("_pid", *keys).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{w}").over(wo), F.lit(0)).alias(f"_o_{w}")
                                       for w in weights])
    wi = Window.partitionBy("_pid", *keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = h.select("*", *[F.coalesce(F.sum(w).over(wi), F.lit(0)).alias(f"_i_{w}") for w in weights])
    out = null_safe_join(inner, offs, ["_pid"] + keys)
    return out.select(*hist.columns, *[(F.col(f"_o_{w}") + F.col(f"_i_{w}")).alias(f"{w}_before")
                                       for w in weights])
