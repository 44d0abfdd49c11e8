"""Profiling: shape, head/tail, describe, nulls, distinct values, duplicates,
class distributions.

Every operator returns a small DataFrame. Wide aggregates are evaluated in a
single pass and reshaped afterwards, so there is one scan per statistic
family, never one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import numeric_columns, stats_row
from ..functions.quantiles import quantile_values

# Fixed value of the reference: a column whose values are listed as classes
# has at most this many distinct values.
MAX_CLASSES = 20


def _stack_one_row(row_df: DataFrame, cols, fields) -> DataFrame:
    """Turn a one-row frame with columns ``{c}__{f}`` into one row per column."""
    return row_df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields])
        for c in cols])).alias("s")).select("s.*")


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def head_rows(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First n rows by an explicit order (a TakeOrdered, no global sort)."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order_by).limit(n)


def tail_rows(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """Last n rows by an explicit order, returned in ascending order."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    last = df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)
    return last.orderBy(*order_by)


def describe_numeric(df: DataFrame, cols=None) -> DataFrame:
    """count, mean, std (ddof=1), min, 25/50/75 % (linear), max per numeric column."""
    cols = list(cols or numeric_columns(df))
    mom = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"),
        F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
        F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std"),
        F.min(F.col(c).cast("double")).alias(f"{c}__min"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    mom = _stack_one_row(mom, cols, ["count", "mean", "std", "min", "max"])
    qv = quantile_values(df, cols, [0.25, 0.5, 0.75])
    q = df.sparkSession.createDataFrame(
        [(c, *qv[c]) for c in cols], "column string, q25 double, q50 double, q75 double")
    return (mom.join(q, "column", "left")
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def null_counts(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """(column, n_null) for every column; ``only_missing`` keeps n_null > 0."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__n_null") for c in df.columns])
    out = _stack_one_row(row, df.columns, ["n_null"])
    return out.where(F.col("n_null") > 0) if only_missing else out


def distinct_counts(df: DataFrame, cols=None, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """(column, n_distinct), nulls excluded. ``approx`` uses HyperLogLog++."""
    cols = list(cols or df.columns)
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    row = df.agg(*[f(F.col(c)).alias(f"{c}__n_distinct") for c in cols])
    return _stack_one_row(row, cols, ["n_distinct"])


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """Rows equal to an earlier row (nulls compare equal): n - distinct rows."""
    subset = list(subset or df.columns)
    g = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def class_distribution(df: DataFrame, cols=None, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(column, value, count) for every column with <= max_classes distinct values.

    Columns are pre-screened with a one-pass HyperLogLog estimate so that
    high-cardinality columns are never grouped exactly; survivors are then
    counted exactly and screened again.
    """
    cols = list(cols or df.columns)
    est = stats_row(df, {c: F.approx_count_distinct(c, 0.01) for c in cols})
    cand = [c for c in cols if est[c] is not None and est[c] <= max_classes * 1.1 + 2]
    if not cand:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cand
    ])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window
    w = Window.partitionBy("column")
    return (counts.withColumn("_k", F.count(F.lit(1)).over(w))
            .where(F.col("_k") <= max_classes).drop("_k"))
