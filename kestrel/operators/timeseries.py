"""Time-series operators: smoothing, interpolation, alignment, correlation,
autocorrelation, calendar summaries and windowed datasets.

A series is the set of rows sharing ``series_cols`` (empty = one series),
ordered by ``time_col`` (plus a tie-breaker when times repeat). Operators that
look back a bounded number of rows use ``position.halo_frame`` so that no
series has to fit in one task; operators that need unbounded context
(interpolation, ranks) use two-level scans over range buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import stats_row
from ..functions.quantiles import quantiles_long
from ..functions.stats import corr_pvalue, durbin_levinson
from .position import global_position, halo_frame, null_safe_join, running_totals
from .resample import bin_start, resample_mean  # noqa: F401  (re-exported)


def _order(time_col, tie):
    return [time_col] + ([tie] if tie else [])


# ------------------------------------------------------------------ rolling

def rolling_mean(df: DataFrame, time_col: str, value_col: str, window: int = 6,
                 series_cols=(), tie: str | None = None, out: str = "rolling_mean") -> DataFrame:
    """Trailing mean over ``window`` points; NULL until ``window`` points exist.

    Rows whose value is NULL are removed first (as the reference does).
    """
    series_cols = list(series_cols)
    d = df.where(F.col(value_col).isNotNull())
    h = halo_frame(d, series_cols, _order(time_col, tie), window - 1)
    w = Window.partitionBy(*series_cols, "_part").orderBy("_pos").rowsBetween(-(window - 1), 0)
    r = (h.withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn(out, F.when(F.col("_n") == window, F.avg(F.col(value_col).cast("double")).over(w)))
         .where(~F.col("_halo")))
    return r.drop("_n", "_part", "_halo", "_pos")


# ------------------------------------------------------------ interpolation

def interpolate_linear(df: DataFrame, time_col: str, value_col: str, series_cols=(),
                       tie: str | None = None) -> DataFrame:
    """Fill NULLs linearly by position between the neighbouring known values.

    Leading NULLs stay NULL; trailing NULLs take the last known value (the
    behaviour of pandas ``interpolate()``). Two-level scan: neighbours inside
    a range bucket by window, across buckets from a small per-bucket table.
    """
    keys = list(series_cols)
    p = global_position(df, keys, _order(time_col, tie), keep_bucket=True)
    kv = F.when(F.col(value_col).isNotNull(), F.struct(F.col("_pos").alias("p"),
                                                       F.col(value_col).cast("double").alias("v")))
    p = p.withColumn("_kv", kv)
    wb = Window.partitionBy(*keys, "_bucket").orderBy("_pos")
    p = (p.withColumn("_prev_l", F.last("_kv", ignorenulls=True).over(
            wb.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_next_l", F.first("_kv", ignorenulls=True).over(
            wb.rowsBetween(0, Window.unboundedFollowing))))
    # per bucket: last and first known value -> carried across buckets
    summ = p.groupBy(*keys, "_bucket").agg(F.max_by("_kv", F.when(F.col("_kv").isNotNull(), F.col("_pos"))).alias("_lastb"),
                                           F.min_by("_kv", F.when(F.col("_kv").isNotNull(), F.col("_pos"))).alias("_firstb"))
    ws = Window.partitionBy(*keys).orderBy("_bucket")
    summ = (summ.withColumn("_carry_prev", F.last("_lastb", ignorenulls=True).over(
                ws.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_carry_next", F.first("_firstb", ignorenulls=True).over(
                ws.rowsBetween(1, Window.unboundedFollowing)))
            .select(*keys, "_bucket", "_carry_prev", "_carry_next"))
    j = null_safe_join(p, summ, keys + ["_bucket"])
    prev = F.coalesce("_prev_l", "_carry_prev")
    nxt = F.coalesce("_next_l", "_carry_next")
    interp = (F.when(F.col(value_col).isNotNull(), F.col(value_col).cast("double"))
              .when(prev.isNull(), F.lit(None))
              .when(nxt.isNull(), prev["v"])
              .otherwise(prev["v"] + (nxt["v"] - prev["v"]) * (F.col("_pos") - prev["p"]) / (nxt["p"] - prev["p"])))
    return j.withColumn(value_col, interp).select(*df.columns)


# --------------------------------------------------------------- alignment

def align_series(df: DataFrame, time_col: str, col_a: str, col_b: str, freq: str | None = None,
                 start=None, end=None) -> DataFrame:
    """Two numeric columns on one time axis; optional mean resample; rows with
    a NULL in either column removed. Output (time_col, a, b)."""
    from ..functions.scalar import time_range
    d = time_range(df, time_col, start, end)
    if freq:
        d = (d.groupBy(bin_start(F.col(time_col), freq).alias(time_col))
             .agg(F.avg(F.col(col_a).cast("double")).alias("a"), F.avg(F.col(col_b).cast("double")).alias("b")))
    else:
        d = d.select(time_col, F.col(col_a).cast("double").alias("a"), F.col(col_b).cast("double").alias("b"))
    return d.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def corr_pearson(aligned: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(r, n, p_value); p two-sided from the t distribution with n - 2 df."""
    r = stats_row(aligned, {"r": F.corr(a, b), "n": F.count(F.lit(1))})
    p = corr_pvalue(r["r"], r["n"])
    return aligned.sparkSession.createDataFrame([(r["r"], r["n"], p)], "r double, n long, p_value double")


def average_ranks(df: DataFrame, col: str, out: str, keys=()) -> DataFrame:
    """Add the average rank (1-based, ties share the mean rank) of ``col``
    inside each group of ``keys``. Value histogram -> distributed running
    counts (``position.running_totals``) -> ranks joined back on the value."""
    keys = list(keys)
    hist = (df.where(F.col(col).isNotNull()).groupBy(*keys, col)
            .agg(F.count(F.lit(1)).alias("_c")))
    ranks = running_totals(hist, keys, col, ["_c"]).select(
        *keys, col, (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias(out))
    return null_safe_join(df, ranks, keys + [col], "left")


def corr_spearman(aligned: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(r, n, p_value): Pearson correlation of average ranks."""
    rk = average_ranks(average_ranks(aligned, a, "_ra"), b, "_rb")
    r = stats_row(rk, {"r": F.corr("_ra", "_rb"), "n": F.count(F.lit(1))})
    p = corr_pvalue(r["r"], r["n"])
    return aligned.sparkSession.createDataFrame([(r["r"], r["n"], p)], "r double, n long, p_value double")


# ---------------------------------------------------------- autocorrelation

def lag_products(df: DataFrame, time_col: str, value_col: str, max_lag: int, series_cols=(),
                 tie: str | None = None) -> DataFrame:
    """Per series: n, mean, and sum_{t} (x_t - m)(x_{t-k} - m) for k = 0..L.

    Returns one row per series with array ``s`` (length L+1). Mean per
    series first (one aggregation), then one halo window pass for all lags.
    """
    keys = list(series_cols)
    d = df.where(F.col(value_col).isNotNull())
    m = d.groupBy(*keys).agg(F.avg(F.col(value_col).cast("double")).alias("_m"),
                             F.count(F.lit(1)).alias("n"))
    h = halo_frame(d, keys, _order(time_col, tie), max_lag)
    h = _with_scalar(h, m, keys)
    x = F.col(value_col).cast("double") - F.col("_m")
    w = Window.partitionBy(*keys, "_part").orderBy("_pos")
    h = h.withColumn("_x", x)
    prods = [F.col("_x") * F.col("_x")] + [F.col("_x") * F.lag("_x", k).over(w) for k in range(1, max_lag + 1)]
    h = h.select(*keys, "_halo", "n", "_m", *[p.alias(f"_p{k}") for k, p in enumerate(prods)]).where(~F.col("_halo"))
    return h.groupBy(*keys, "n", "_m").agg(F.array(*[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0))
                                                     for k in range(max_lag + 1)]).alias("s"))


def _with_scalar(h: DataFrame, m: DataFrame, keys):
    """Attach the one-row statistics of an unkeyed series as literals."""
    if keys:
        return null_safe_join(h, m, keys)
    r = m.first()
    return h.withColumn("_m", F.lit(r["_m"])).withColumn("n", F.lit(r["n"]))


def acf(df: DataFrame, time_col: str, value_col: str, nlags: int = 48, series_cols=(),
        tie: str | None = None) -> DataFrame:
    """Biased autocorrelation r_k = c_k / c_0 (c_k with denominator n), k = 0..nlags.

    Output (series..., lag, acf).
    """
    keys = list(series_cols)
    s = lag_products(df, time_col, value_col, nlags, keys, tie)
    return s.select(*keys, F.posexplode("s").alias("lag", "_s"), F.col("s")[0].alias("_c0")) \
            .select(*keys, F.col("lag").cast("int").alias("lag"), (F.col("_s") / F.col("_c0")).alias("acf"))


def pacf(df: DataFrame, time_col: str, value_col: str, nlags: int = 48, tie: str | None = None) -> DataFrame:
    """Partial autocorrelation of one series, Yule-Walker with n - k denominators.

    The L+1 lag covariances come from one distributed pass; the Durbin-Levinson
    recursion runs on those L+1 scalars.
    """
    row = lag_products(df, time_col, value_col, nlags, (), tie).first()
    n = row["n"]
    cov = [row["s"][k] / (n - k) for k in range(nlags + 1)]
    vals = durbin_levinson(cov)
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(vals)], "lag int, pacf double")


# --------------------------------------------------------- calendar views

def box_stats(df: DataFrame, value_col: str, group_col: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Per group: q1, median, q3 (exact, linear), whiskers (most extreme points
    inside q1 - 1.5 IQR / q3 + 1.5 IQR), n and number of outlier points."""
    keys = [group_col] if group_col else []
    d = df.select(*keys, F.col(value_col).cast("double").alias("value")).where(F.col("value").isNotNull())
    q = quantiles_long(d.withColumn("column", F.lit(value_col)), None, [0.25, 0.5, 0.75],
                       by=keys, long_input=True)
    q = q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(nm)
                               for p, nm in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    lo = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    j = null_safe_join(d, q, keys) if keys else _attach(d, q)
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    agg = j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("n_outliers"))
    return agg


def _attach(d: DataFrame, q: DataFrame) -> DataFrame:
    r = q.first()
    return d.withColumns({k: F.lit(r[k]) for k in ("q1", "median", "q3")})


def heatmap_weekday_hour(df: DataFrame, time_col: str, value_col: str, timezone: str = "UTC",
                         wide: bool = False) -> DataFrame:
    """Mean by weekday (Monday=0) x hour. Long form has all 7 x 24 cells
    (NULL where no data); wide form has one column per hour ``h0..h23``."""
    from .resample import local_time
    t = local_time(F.col(time_col), timezone)
    d = df.select(F.weekday(t).alias("weekday"), F.hour(t).alias("hour"),
                  F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    if wide:
        return (d.groupBy("weekday").pivot("hour", list(range(24))).agg(F.avg("v"))
                .toDF("weekday", *[f"h{h}" for h in range(24)]))
    agg = d.groupBy("weekday", "hour").agg(F.avg("v").alias("mean"))
    cells = df.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"),
                                                 (F.col("id") % 24).cast("int").alias("hour"))
    return cells.join(agg, ["weekday", "hour"], "left")


# ------------------------------------------------------- windowed datasets

def lag_features(df: DataFrame, time_col: str, value_col: str, n_lags: int = 5, horizon: int = 0,
                 exog=(), series_cols=(), tie: str | None = None) -> DataFrame:
    """Rows i with n_lags <= i < len - horizon: lag_1..lag_n (lag_k = x[i-k]),
    exogenous values at i, target y = x[i]. Positions are per series."""
    keys = list(series_cols)
    d = df.where(F.col(value_col).isNotNull())
    h = halo_frame(d, keys, _order(time_col, tie), n_lags)
    w = Window.partitionBy(*keys, "_part").orderBy("_pos")
    lens = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    h = h.select(*keys, time_col, "_pos", "_halo", *list(exog),
                 *[F.lag(F.col(value_col).cast("double"), k).over(w).alias(f"lag_{k}") for k in range(1, n_lags + 1)],
                 F.col(value_col).cast("double").alias("y")).where(~F.col("_halo"))
    h = _join_len(h, lens, keys)
    return (h.where((F.col("_pos") >= n_lags) & (F.col("_pos") < F.col("_len") - horizon))
            .select(*keys, time_col, *[f"lag_{k}" for k in range(1, n_lags + 1)], *list(exog), "y"))


def _join_len(h, lens, keys):
    if keys:
        return null_safe_join(h, lens, keys)
    return h.withColumn("_len", F.lit(lens.first()["_len"]))


def sequence_windows(df: DataFrame, time_col: str, feature_cols, label_col: str, window: int = 14,
                     series_cols=(), tie: str | None = None) -> DataFrame:
    """For t >= window: ``seq`` = features of rows t-window..t-1 (array of
    arrays, oldest first) and ``label`` at t. Rows with a NULL in any feature
    or the label are removed first."""
    keys = list(series_cols)
    feature_cols = list(feature_cols)
    d = df.na.drop(subset=feature_cols + [label_col])
    h = halo_frame(d, keys, _order(time_col, tie), window)
    w = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(-window, -1)
    feat = F.array(*[F.col(c).cast("double") for c in feature_cols])
    h = (h.withColumn("seq", F.collect_list(feat).over(w))
         .where(~F.col("_halo") & (F.col("_pos") >= window)))
    return h.select(*keys, time_col, "seq", F.col(label_col).cast("int").alias("label"))


def multi_horizon_dataset(df: DataFrame, time_col: str, value_col: str, n_lags: int = 10,
                          horizon: int = 10, series_cols=(), tie: str | None = None,
                          scale: bool = True):
    """Scaled (min-max per series) windows: x = n_lags past values, y = next
    ``horizon`` values, for n_lags <= i < len - horizon.

    Look-ahead is turned into look-back: the row j = i + horizon - 1 sees the
    n_lags + horizon values ending at j. Returns (dataset, per-series min/max).
    """
    keys = list(series_cols)
    d = df.where(F.col(value_col).isNotNull())
    mm = d.groupBy(*keys).agg(F.min(F.col(value_col).cast("double")).alias("_lo"),
                              F.max(F.col(value_col).cast("double")).alias("_hi"),
                              F.count(F.lit(1)).alias("_len"))
    span = n_lags + horizon
    h = halo_frame(d, keys, _order(time_col, tie), span - 1)
    h = null_safe_join(h, mm, keys) if keys else h.withColumns({k: F.lit(v) for k, v in mm.first().asDict().items()})
    x = F.col(value_col).cast("double")
    if scale:
        x = (x - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    w = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(-(span - 1), 0)
    h = (h.withColumn("_win", F.collect_list(x).over(w))
         .where(~F.col("_halo") & (F.col("_pos") >= span - 1) & (F.col("_pos") <= F.col("_len") - 2)))
    out = h.select(*keys, (F.col("_pos") - horizon + 1).alias("i"),
                   F.slice("_win", 1, n_lags).alias("x"), F.slice("_win", n_lags + 1, horizon).alias("y"))
    return out, mm
