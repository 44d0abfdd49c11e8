"""Exact quantiles (linear interpolation, ``pos = p * (n - 1)``) at scale.

Spark's exact ``percentile`` keeps a value->count map per group and merges it in
one task, so a large group with many distinct values does not fit. Here, for
groups and columns of any size alike:

1. rows become a histogram (one row per group, column and distinct value; the
   aggregation combines on the map side, so a value that fills most rows is a
   few counts);
2. running counts over the histogram come from ``position.running_totals``:
   range partitions and a small table of their offsets;
3. the two order statistics around ``pos`` are the histogram rows whose range of
   ranks holds them, picked by a filter, and are interpolated.

No rows are ranked, no task holds more than a range partition of the histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import unpivot_numeric


def quantiles_long(df: DataFrame, cols, probs, by=(), long_input: bool = False) -> DataFrame:
    """Exact quantiles in long form: (by..., column, prob, n, quantile).

    ``long_input=True`` means ``df`` already has columns (by..., column, value).
    NULL and NaN values are ignored; NULL group keys form a group of their own.
    """
    from ..operators.position import null_safe_join, running_totals
    keys = [*by, "column"]
    long = df if long_input else unpivot_numeric(df, list(cols), keep=list(by))
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    hist = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(hist, keys, "value", ["_c"])
    # ``ranked`` starts from a materialised histogram, so both uses of it are cheap.
    sizes = ranked.groupBy(*keys).agg(F.max(F.col("_c_before") + F.col("_c")).alias("n"))
    want = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    want = want.withColumn("_pos", F.col("prob") * (F.col("n") - 1))
    want = want.withColumn("_r0", F.floor("_pos").cast("long"))
    want = want.withColumn("_r1", F.least(F.col("_r0") + 1, F.col("n") - 1))
    # few wanted ranks per group: an array per group, matched inside the row
    ranks = want.groupBy(*keys).agg(F.collect_list(F.struct("prob", "n", "_pos", "_r0", "_r1")).alias("_w"))
    lo, hi = F.col("_c_before"), F.col("_c_before") + F.col("_c")
    hit = null_safe_join(ranked, ranks, keys).select(*keys, "value", "_c_before", "_c", F.explode(F.filter(
        "_w", lambda w: ((w["_r0"] >= lo) & (w["_r0"] < hi)) | ((w["_r1"] >= lo) & (w["_r1"] < hi)))).alias("w"))
    at = lambda r: F.max(F.when((F.col(r) >= lo) & (F.col(r) < hi), F.col("value")))
    both = hit.groupBy(*keys, "w.prob", "w.n", "w._pos", "w._r0").agg(at("w._r0").alias("_v0"), at("w._r1").alias("_v1"))
    return both.select(*keys, "prob", "n", (
        F.col("_v0") + (F.col("_pos") - F.col("_r0")) * (F.col("_v1") - F.col("_v0"))).alias("quantile"))


def quantile_values(df: DataFrame, cols, probs) -> dict:
    """Global exact quantiles as {column: [q(p) for p in probs]}; NULL where a column has no value.

    What travels to the driver is one number per column and probability.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    out = {c: [None] * len(probs) for c in cols}
    if cols:
        for r in quantiles_long(df, cols, probs).collect():
            for j, p in enumerate(probs):
                if p == r["prob"]:
                    out[r["column"]][j] = r["quantile"]
    return out
