"""Fixed-width time bins, bin spines and resampled aggregates.

Bins are computed with ``window(ts, width).start`` (tumbling, aligned on the
epoch, keeps the NTZ/LTZ type of the input). Daily bins are cut in local
wall-clock time of ``timezone``, so a 23-hour or 25-hour day is one bin.
Every series gets its own contiguous range of bins from its first to its
last observation ("spine"); bins without rows carry NULL aggregates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import numeric_columns
from ..functions.quantiles import quantiles_long

# Frequency aliases offered by the reference: 15 minutes, 30 minutes, hour, day.
_FREQ = {"T": "minutes", "MIN": "minutes", "H": "hours", "D": "days", "S": "seconds"}


def parse_freq(freq: str) -> tuple[int, str]:
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    n = int(m.group(1) or 1)
    unit = _FREQ.get(m.group(2).upper())
    if unit is None:
        raise ValueError(f"unknown frequency unit {freq!r}")
    return n, unit


def freq_interval(freq: str) -> str:
    n, unit = parse_freq(freq)
    return f"{n} {unit}"


def local_time(ts: Column, timezone: str = "UTC") -> Column:
    """Wall-clock time in ``timezone`` of a UTC instant stored without zone."""
    if timezone.upper() == "UTC":
        return ts
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts.cast("timestamp_ntz"))


def bin_start(ts: Column, freq: str, timezone: str = "UTC") -> Column:
    """Start of the tumbling bin of ``freq`` that holds ``ts``."""
    n, unit = parse_freq(freq)
    t = local_time(ts, timezone) if unit == "days" else ts
    return F.window(t, f"{n} {unit}").start


SPINE_BINS = 4096   # bins that one row of the spine's first level stands for


def spine(bounds: DataFrame, keys, lo: str, hi: str, freq: str, name: str) -> DataFrame:
    """Every bin from lo to hi (inclusive) per key, in two levels of explode.

    The first makes one row per SPINE_BINS bins, the second the bins, so a long
    series is never one array in one row; the rows in between can be spread.
    """
    n, unit = parse_freq(freq)
    step, wide = F.expr(f"INTERVAL {n} {unit}"), F.expr(f"INTERVAL {n * SPINE_BINS} {unit}")
    part = bounds.select(*keys, F.col(hi).alias("_hi"), F.explode(F.sequence(F.col(lo), F.col(hi), wide)).alias("_from"))
    last = F.least(F.col("_hi"), F.col("_from") + F.expr(f"INTERVAL {n * (SPINE_BINS - 1)} {unit}"))
    return part.select(*keys, F.explode(F.sequence(F.col("_from"), last, step)).alias(name))


def resample_agg(df: DataFrame, time_col: str, freq: str, funcs=("mean", "max"),
                 group_col: str | None = None, cols=None, timezone: str = "UTC") -> DataFrame:
    """Aggregate numeric columns per (group, bin); output ``{col}_{func}``.

    funcs from {mean, max, min, std (ddof=1), median (exact)}. Each group has
    its own bin range; empty bins are present with NULLs. Rows with a NULL group
    or a NULL time belong to no bin and are left out (the pandas group-by rule).
    """
    keys = [group_col] if group_col else []
    cols = list(cols or numeric_columns(df, exclude=[time_col] + keys))
    binned = df.na.drop(subset=keys + [time_col]).select(
        *keys, bin_start(F.col(time_col), freq, timezone).alias(time_col), *[F.col(c).cast("double").alias(c) for c in cols])
    fn = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    plain = [f for f in funcs if f != "median"]
    aggs = [fn[f](c).alias(f"{c}_{f}") for c in cols for f in plain]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    agg = binned.groupBy(*keys, time_col).agg(*aggs)
    if "median" in funcs:
        med = quantiles_long(binned, cols, [0.5], by=keys + [time_col])
        med = med.groupBy(*keys, time_col).agg(*[
            F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{c}_median") for c in cols])
        agg = agg.join(med, keys + [time_col], "left")
    bounds = agg.groupBy(*keys).agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
    sp = spine(bounds, keys, "_lo", "_hi", freq, time_col)
    out_cols = [f"{c}_{f}" for c in cols for f in funcs]
    return sp.join(agg, keys + [time_col], "left").select(*keys, time_col, *out_cols)


def resample_mean(df: DataFrame, time_col: str, value_col: str, freq: str = "1H",
                  series_cols=(), timezone: str = "UTC") -> DataFrame:
    """Mean per bin, every bin from first to last present (empty -> NULL).

    Rows with a NULL series key or time are left out, as in ``resample_agg``.
    """
    keys = list(series_cols)
    b = df.na.drop(subset=keys + [time_col]).select(*keys, bin_start(F.col(time_col), freq, timezone).alias(time_col),
                  F.col(value_col).cast("double").alias(value_col))
    agg = b.groupBy(*keys, time_col).agg(F.avg(value_col).alias(value_col))
    bounds = agg.groupBy(*keys).agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
    return spine(bounds, keys, "_lo", "_hi", freq, time_col).join(agg, keys + [time_col], "left")
