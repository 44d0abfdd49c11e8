"""Cleaning: imputation, duplicates, encoding, scaling, outliers.

Operators with fitted statistics are split into ``fit_*`` (one aggregation,
a few scalars per column) and a projection that uses those scalars as
literals, so the same statistics can be applied to new data and the
transform stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import MAX_LEVELS, is_numeric, numeric_columns, stats_row
from ..functions.quantiles import quantile_values
from .position import dense_index


def _num(df, cols):
    cols = list(cols) if cols else numeric_columns(df)
    return [c for c in cols if is_numeric(df, c)]


def _replace(df: DataFrame, repl: dict) -> DataFrame:
    return df.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


# --------------------------------------------------------------------- nulls

def impute_mean(df: DataFrame, cols=None) -> DataFrame:
    """Fill NULLs of numeric columns with the column mean (others skipped).

    Columns without NULLs keep their type; filled columns become double.
    """
    cols = _num(df, cols)
    m = stats_row(df, {k: v for c in cols for k, v in (
        (f"{c}__m", F.avg(F.col(c).cast("double"))), (f"{c}__z", F.count_if(F.col(c).isNull())))})
    return _replace(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(m[f"{c}__m"]))
                         for c in cols if m[f"{c}__z"]})


def impute_median(df: DataFrame, cols=None) -> DataFrame:
    """Fill NULLs of numeric columns with the exact column median."""
    cols = _num(df, cols)
    z = stats_row(df, {c: F.count_if(F.col(c).isNull()) for c in cols})
    cols = [c for c in cols if z[c]]
    q = quantile_values(df, cols, [0.5])
    return _replace(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(q[c][0])) for c in cols})


# ---------------------------------------------------------------- duplicates

def dedup(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Drop repeated rows on ``subset`` (all columns by default), keep first.

    With all columns as key, repeats are identical, so ``dropDuplicates``.
    Otherwise the kept row is the one with the smallest ``order_by`` (all
    columns when not given), chosen with ``min_by`` - a hash aggregate with
    map-side partial aggregation, so a hot key is reduced before the shuffle.
    """
    subset = list(subset) if subset else list(df.columns)
    if set(subset) == set(df.columns):
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in subset]
    order_by = [order_by] if isinstance(order_by, str) else list(order_by or df.columns)
    keep = df.groupBy(*subset).agg(
        F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_keep"))
    return keep.select(*subset, "_keep.*").select(*df.columns)



# ------------------------------------------------------------------ encoding

def label_encode(df: DataFrame, cols) -> DataFrame:
    """Text value -> its 0-based rank among the sorted distinct values.

    NULL is encoded as the text ``nan`` (a value like any other). The
    dictionary of each column is ranked by ``dense_index`` (distributed) and
    joined back; the join is broadcast only when AQE measures it small.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    out = df
    for c in cols:
        txt = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        tmp = f"__{c}_txt"
        out = out.withColumn(tmp, txt)
        dic = dense_index(out.select(tmp), tmp, out=f"__{c}_code")
        out = (out.join(dic, tmp, "left")
               .withColumn(c, F.col(f"__{c}_code").cast("int"))
               .drop(tmp, f"__{c}_code"))
    return out.select(*df.columns)


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values of a column, at most ``max_levels``.

    One-hot output width equals this list, so it is bounded on purpose: the
    distinct values are grouped on the cluster and only a bounded number
    comes back (more than ``max_levels`` raises).
    """
    vals = (df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull())
            .distinct().orderBy("v").limit(max_levels + 1).collect())
    if len(vals) > max_levels:
        raise ValueError(f"column {col!r} has more than {max_levels} levels")
    return [r["v"] for r in vals]


def one_hot(df: DataFrame, cols, drop_first: bool = False, max_levels: int = MAX_LEVELS,
            levels_by_col: dict | None = None) -> DataFrame:
    """``{col}_{value}`` 0/1 columns sorted by value, appended; originals removed.

    A NULL row has 0 in every dummy. ``drop_first`` omits the first level.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    extra = []
    for c in cols:
        lv = (levels_by_col or {}).get(c) or levels(df, c, max_levels)
        if drop_first:
            lv = lv[1:]
        s = F.col(c).cast("string")
        extra += [F.coalesce((s == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in lv]
    return df.select(*[x for x in df.columns if x not in cols], *extra)


def one_hot_drop_first(df: DataFrame, cols, max_levels: int = MAX_LEVELS) -> DataFrame:
    return one_hot(df, cols, drop_first=True, max_levels=max_levels)


# ------------------------------------------------------------------- scaling

def fit_standard(df, cols) -> dict:
    r = stats_row(df, {k: v for c in cols for k, v in (
        (f"{c}__m", F.avg(F.col(c).cast("double"))), (f"{c}__s", F.stddev_pop(F.col(c).cast("double"))))})
    return {c: (r[f"{c}__m"], r[f"{c}__s"]) for c in cols}


def scale_standard(df: DataFrame, cols=None, params: dict | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0; NULL stays."""
    cols = _num(df, cols)
    p = params or fit_standard(df, cols)
    return _replace(df, {c: (F.col(c) - F.lit(p[c][0])) / F.lit(p[c][1] if p[c][1] else 1.0) for c in cols})


def fit_minmax(df, cols) -> dict:
    r = stats_row(df, {k: v for c in cols for k, v in (
        (f"{c}__lo", F.min(F.col(c).cast("double"))), (f"{c}__hi", F.max(F.col(c).cast("double"))))})
    return {c: (r[f"{c}__lo"], r[f"{c}__hi"]) for c in cols}


def scale_minmax(df: DataFrame, cols=None, params: dict | None = None) -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; a constant column becomes 0."""
    cols = _num(df, cols)
    p = params or fit_minmax(df, cols)

    def rng(c):
        lo, hi = p[c]
        return (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
    return _replace(df, {c: (F.col(c) - F.lit(p[c][0])) / F.lit(rng(c)) for c in cols})


def scale_minmax_inverse(df: DataFrame, params: dict) -> DataFrame:
    """Back to original units with the (min, max) stored by ``fit_minmax``."""
    def rng(lo, hi):
        return (hi - lo) if hi != lo else 1.0
    return _replace(df, {c: F.col(c) * F.lit(rng(lo, hi)) + F.lit(lo)
                         for c, (lo, hi) in params.items() if c in df.columns})


def fit_robust(df, cols) -> dict:
    q = quantile_values(df, cols, [0.25, 0.5, 0.75])
    return {c: (q[c][1], (q[c][2] - q[c][0]) if q[c][0] is not None else None) for c in cols}


def scale_robust(df: DataFrame, cols=None, params: dict | None = None) -> DataFrame:
    """(x - median) / IQR (exact quartiles); IQR 0 -> divisor 1."""
    cols = _num(df, cols)
    p = params or fit_robust(df, cols)
    return _replace(df, {c: (F.col(c) - F.lit(p[c][0])) / F.lit(p[c][1] if p[c][1] else 1.0) for c in cols})


# ------------------------------------------------------------------ outliers

def outlier_flag_iqr(df: DataFrame, cols, k: float = 1.5):
    """Column expression: any chosen column outside [Q1 - k IQR, Q3 + k IQR]."""
    q = quantile_values(df, cols, [0.25, 0.75])
    conds = []
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        x = F.col(c).cast("double")
        conds.append(F.coalesce((x < F.lit(q1 - k * iqr)) | (x > F.lit(q3 + k * iqr)), F.lit(False)))
    return _any(conds)


def outlier_flag_zscore(df: DataFrame, cols, threshold: float = 3.0):
    """Column expression: any chosen column with |x - mean| / sample std > threshold."""
    r = stats_row(df, {k: v for c in cols for k, v in (
        (f"{c}__m", F.avg(F.col(c).cast("double"))), (f"{c}__s", F.stddev_samp(F.col(c).cast("double"))))})
    conds = []
    for c in cols:
        m, s = r[f"{c}__m"], r[f"{c}__s"]
        if m is None or not s:
            continue
        conds.append(F.coalesce(F.abs((F.col(c) - F.lit(m)) / F.lit(s)) > F.lit(threshold), F.lit(False)))
    return _any(conds)


def _any(conds):
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _flag(df, cols, method, threshold):
    cols = _num(df, cols)
    if method == "iqr":
        return cols, outlier_flag_iqr(df, cols)
    if method == "zscore":
        return cols, outlier_flag_zscore(df, cols, threshold)
    raise ValueError(f"unknown outlier method {method!r}")


def outliers_iqr(df: DataFrame, cols=None) -> DataFrame:
    """Rows with the boolean column ``is_outlier`` (IQR rule, any column)."""
    cols, f = _flag(df, cols, "iqr", None)
    return df.withColumn("is_outlier", f)


def outliers_zscore(df: DataFrame, cols=None, threshold: float = 3.0) -> DataFrame:
    cols, f = _flag(df, cols, "zscore", threshold)
    return df.withColumn("is_outlier", f)


def outliers_remove(df: DataFrame, cols=None, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    cols, f = _flag(df, cols, method, threshold)
    return df.where(~f)


def outliers_replace_mean(df: DataFrame, cols=None, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """In flagged rows every chosen column takes its mean over all rows."""
    cols, f = _flag(df, cols, method, threshold)
    m = stats_row(df, {c: F.avg(F.col(c).cast("double")) for c in cols})
    return _replace(df, {c: F.when(f, F.lit(m[c])).otherwise(F.col(c).cast("double")) for c in cols})


def outliers_replace_median(df: DataFrame, cols=None, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    cols, f = _flag(df, cols, method, threshold)
    q = quantile_values(df, cols, [0.5])
    return _replace(df, {c: F.when(f, F.lit(q[c][0])).otherwise(F.col(c).cast("double")) for c in cols})


def outliers_mark(df: DataFrame, cols=None, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """``{col}_is_outlier`` = row flag as 0/1 for every chosen column (always added)."""
    cols, f = _flag(df, cols, method, threshold)
    return df.withColumns({f"{c}_is_outlier": f.cast("int") for c in cols})
