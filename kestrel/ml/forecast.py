"""Forecasting and per-series decomposition.

Three shapes of work:

* ARIMA(p, d, 0) is a regression from grouped sums over lag rows;
* the other per-series solvers (STL, DTW, smoothing, theta, trend+season ridge,
  automatic selection) run as ``groupBy(series).applyInPandas``: Spark
  partitions and shuffles the series, each task runs numpy on ONE resampled
  series (its length is its number of time bins, not its raw row count);
  many series run in parallel;
* window models (random forest / boosted trees on lags, direct multi-horizon
  linear models) are ONE global MLlib model over the lag rows of all series,
  and the recursive forecast is h small distributed rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.position import global_position, halo_frame, null_safe_join
from ..session import cut_lineage
from ..operators.resample import resample_mean
from ..operators.timeseries import interpolate_linear, lag_features, multi_horizon_dataset
from . import series_kernels as K
from .models import features_vector

DEFAULT_H = 10          # reference default horizon
DEFAULT_PERIOD = 24     # reference default STL period
DEFAULT_LAGS = 5        # reference default lags of the window models
# Fixed values of the reference: search effort levels and their generation counts.
SEARCH_LEVELS = {"rápido": 2, "medio": 5, "exhaustivo": 10}


def regular_series(df: DataFrame, time_col: str, value_col: str, freq: str = "1H", series_cols=()) -> DataFrame:
    """Mean per bin with every bin present, gaps filled linearly (the
    reference's ``resample(freq).mean().interpolate()``)."""
    r = resample_mean(df, time_col, value_col, freq, series_cols)
    return interpolate_linear(r, time_col, value_col, series_cols)


def _keys_schema(df, keys):
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


# ------------------------------------------------------------------- STL

def stl_decompose(series: DataFrame, time_col: str, value_col: str, series_cols=(), period: int = DEFAULT_PERIOD,
                  seasonal: int = 7) -> DataFrame:
    """(series..., time, observed, trend, seasonal, resid) per regular series."""
    keys = list(series_cols)
    d = series.select(*keys, time_col, F.col(value_col).cast("double").alias("observed")).where("observed IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        y = pdf["observed"].to_numpy(dtype=float)
        if len(y) < 2 * period:
            T = S = R = [None] * len(y)
        else:
            T, S, R = K.stl(y, period, seasonal)
        return pdf.assign(trend=T, seasonal=S, resid=R)

    ks = _keys_schema(d, keys)
    schema = (ks + ", " if ks else "") + f"`{time_col}` {d.schema[time_col].dataType.simpleString()}, " \
        "observed double, trend double, seasonal double, resid double"
    if keys:
        return d.groupBy(*keys).applyInPandas(run, schema)
    one = d.withColumn("_one", F.lit(0))
    return one.groupBy("_one").applyInPandas(lambda p: run(p.drop(columns="_one")), schema)


# ------------------------------------------------------------------- DTW

def dtw_distance(df: DataFrame, time_col: str, value_col: str, series_col: str, pairs: DataFrame | None = None,
                 window: int = 0) -> DataFrame:
    """DTW distance of pairs of series: (a, b, n_a, n_b, dtw).

    ``pairs`` (a, b) names the pairs; without it every two series that ``df`` has
    are compared. Each series is sent to the pairs that use it; the dynamic
    programme of a pair is one task, pairs run in parallel.
    """
    s = df.select(F.col(series_col).cast("string").alias("_s"), time_col, F.col(value_col).cast("double").alias("v")) \
          .where("v IS NOT NULL AND _s IS NOT NULL")
    if pairs is None:
        names = s.select("_s").distinct()
        pairs = names.select(F.col("_s").alias("a")).join(names.select(F.col("_s").alias("b")), F.col("a") < F.col("b"))
    pr = cut_lineage(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).distinct())
    left = s.join(pr, s["_s"] == pr["a"]).select("a", "b", F.lit(0).alias("side"), time_col, "v")
    right = s.join(pr, s["_s"] == pr["b"]).select("a", "b", F.lit(1).alias("side"), time_col, "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        x = pdf.loc[pdf.side == 0, "v"].to_numpy(dtype=float)
        y = pdf.loc[pdf.side == 1, "v"].to_numpy(dtype=float)
        return pd.DataFrame({"a": [pdf.a.iloc[0]], "b": [pdf.b.iloc[0]], "n_a": [len(x)], "n_b": [len(y)],
                             "dtw": [K.dtw(x, y, window)]})

    return left.unionByName(right).groupBy("a", "b").applyInPandas(
        run, "a string, b string, n_a long, n_b long, dtw double")


# ------------------------------------------------------------ forecasters

def _per_series(series: DataFrame, time_col, value_col, keys, fn, out_schema: str, exog=()):
    keys = list(keys)
    d = series.select(*keys, time_col, F.col(value_col).cast("double").alias("_y"), *exog).where("_y IS NOT NULL")
    if not keys:
        d = d.withColumn("_one", F.lit(0))
        keys_g = ["_one"]
    else:
        keys_g = keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        key_vals = {k: pdf[k].iloc[0] for k in keys}
        out = fn(pdf)
        for k, v in key_vals.items():
            out.insert(0, k, v)
        return out

    ks = _keys_schema(d, keys)
    return d.groupBy(*keys_g).applyInPandas(run, (ks + ", " if ks else "") + out_schema)


def arima_forecast(series: DataFrame, time_col: str, value_col: str, series_cols=(), h: int = DEFAULT_H,
                   order=(1, 1, 0), exog=()) -> DataFrame:
    """(series..., step, forecast): ARIMA(p, d, 0) by conditional least squares.

    The d-times differenced value is regressed on its p predecessors and the
    differenced exogenous columns, per series. Lags come from a halo frame and the
    means and covariances of the regression from one grouped aggregation, so a
    series of any length is spread over tasks; only those (p + m)^2 numbers per
    series are solved in a vectorised function. A regressor that never varies gets
    the coefficient 0. Future exogenous values are the last h known rows. Steps
    continue the series' positions; a series of at most p + d values has NULL
    forecasts. A moving-average order isn't supported and raises.
    """
    p, dd, q = order
    if q:
        raise ValueError("moving-average terms are not supported: order must be (p, d, 0)")
    keys, exog = list(series_cols), list(exog)
    need = p + dd
    d = series.select(*keys, time_col, F.col(value_col).cast("double").alias("_y"),
                      *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(exog)]).where("_y IS NOT NULL")
    hf = halo_frame(d, keys, [time_col], max(need, 1))
    w = Window.partitionBy(*keys, "_part").orderBy("_pos")

    def differenced(c: str, back: int):
        return sum((-1) ** k * math.comb(dd, k) * F.lag(c, back + k).over(w) for k in range(dd + 1))
    names = [f"_l{k}" for k in range(1, p + 1)] + [f"_d{j}" for j in range(len(exog))]
    hf = hf.select(*keys, "_pos", "_y", "_halo", *[f"_x{j}" for j in range(len(exog))], differenced("_y", 0).alias("_z"),
                   *[differenced("_y", k).alias(f"_l{k}") for k in range(1, p + 1)],
                   *[differenced(f"_x{j}", 0).alias(f"_d{j}") for j in range(len(exog))]).where("NOT _halo")
    hf = cut_lineage(hf)
    m = len(names)
    used = F.col("_pos") >= need
    reg = {c: F.when(used, F.col(c)) for c in [*names, "_z"]}
    lens = hf.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(reg["_z"]).alias("_mz"),
        F.array(*[F.avg(reg[c]) for c in names]).cast("array<double>").alias("_mx"),
        F.array(*[F.covar_pop(reg[a], reg[b]) for a in names for b in names]).cast("array<double>").alias("_cxx"),
        F.array(*[F.covar_pop(reg[c], reg["_z"]) for c in names]).cast("array<double>").alias("_cxz"))
    size = hf.groupBy(*keys).agg(F.max("_pos").alias("_top"))
    reach = max(need, h if exog else 0, 1)
    tail = null_safe_join(hf, size, keys) if keys else hf.withColumn("_top", F.lit(size.first()["_top"]))
    tail = tail.where(F.col("_pos") > F.col("_top") - reach - (dd if exog else 0)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_y", *[f"_x{j}" for j in range(len(exog))]))).alias("_t"))
    tail = tail.select(*keys, F.transform("_t", lambda r: r["_y"]).alias("_ty"), *[
        F.transform("_t", _field(f"_x{j}")).alias(f"_t{j}") for j in range(len(exog))])
    both = null_safe_join(lens, tail, keys) if keys else lens.withColumns(
        {k: F.lit(v).cast("array<double>") for k, v in tail.first().asDict().items()})

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, mz: pd.Series, mx: pd.Series, cxx: pd.Series, cxz: pd.Series, ty: pd.Series,
               *ex: pd.Series) -> pd.Series:
        out = []
        for i in range(len(n)):
            if n[i] <= need:
                out.append([None] * h)
                continue
            coef = np.linalg.pinv(np.reshape(cxx[i], (m, m))) @ np.asarray(cxz[i]) if m else np.zeros(0)
            level = mz[i] - (coef @ np.asarray(mx[i]) if m else 0.0)
            y = np.asarray(ty[i], float)
            z = list(np.diff(y, n=dd))
            future = []
            for x in ex:
                known = np.asarray(x[i], float)
                future.append(np.diff(np.concatenate([known, known[-h:]]), n=dd)[-h:])
            for k in range(h):
                z.append(level + sum(coef[j] * z[-1 - j] for j in range(p))
                         + sum(coef[p + j] * f[k] for j, f in enumerate(future)))
            levels = np.asarray(z[-h:])
            for j in range(dd, 0, -1):
                levels = np.diff(y, n=j - 1)[-1] + np.cumsum(levels)
            out.append(levels.tolist())
        return pd.Series(out)

    found = both.withColumn("_f", solved("_n", "_mz", "_mx", "_cxx", "_cxz", "_ty", *[f"_t{j}" for j in range(len(exog))]))
    return found.select(*keys, "_n", F.posexplode("_f").alias("_k", "forecast")).select(
        *keys, (F.col("_n") + F.col("_k")).cast("long").alias("step"), "forecast")


def _field(name: str):
    return lambda r: r[name]


def trend_season_forecast(series: DataFrame, time_col: str, value_col: str, series_cols=(), h: int = DEFAULT_H,
                          period: int = DEFAULT_PERIOD, exog=()) -> DataFrame:
    """Additive piecewise-linear trend + Fourier seasonality (+ regressors),
    ridge fit per series (the role of the reference's additive model)."""
    exog = list(exog)

    def fn(pdf):
        y = pdf["_y"].to_numpy(dtype=float)
        ex = pdf[exog].to_numpy(dtype=float) if exog else None
        f = K.ridge_season(y, h, period, exog=ex, exog_future=ex[-h:] if exog else None)
        return pd.DataFrame({"step": np.arange(len(y), len(y) + h), "forecast": f})
    return _per_series(series, time_col, value_col, series_cols, fn, "step long, forecast double", exog)


def auto_forecast(series: DataFrame, time_col: str, value_col: str, series_cols=(), h: int = DEFAULT_H) -> DataFrame:
    """Three automatic candidates (ARIMA by AIC, exponential smoothing, theta)
    fitted on all but the last h points, scored by MAE on those h points; the
    best is refitted on the whole series. One row per (series, candidate) with
    its score; the chosen one carries the forecast array."""
    def fn(pdf):
        y = pdf["_y"].to_numpy(dtype=float)
        rows = []
        if len(y) < max(30, 2 * h + 5):
            return pd.DataFrame({"candidate": [None], "spec": ["series too short"], "mae": [None], "chosen": [False],
                                 "forecast": [None]})
        for name, f in K.CANDIDATES.items():
            pred, spec = f(y[:-h], h)
            rows.append((name, spec, float(np.mean(np.abs(pred - y[-h:])))))
        best = min(rows, key=lambda r: (r[2], r[0]))
        full, _ = K.CANDIDATES[best[0]](y, h)
        return pd.DataFrame({"candidate": [r[0] for r in rows], "spec": [r[1] for r in rows],
                             "mae": [r[2] for r in rows], "chosen": [r[0] == best[0] for r in rows],
                             "forecast": [list(map(float, full)) if r[0] == best[0] else None for r in rows]})
    return _per_series(series, time_col, value_col, series_cols, fn,
                       "candidate string, spec string, mae double, chosen boolean, forecast array<double>")


def auto_forecast_search(series: DataFrame, time_col: str, value_col: str, series_cols=(), h: int = DEFAULT_H,
                         level: str = "medio", n_validations: int = 2, interval: float = 0.9) -> DataFrame:
    """Grid of candidates growing with the effort level, scored on
    ``n_validations`` rolling-origin folds of h points; best by mean MAE;
    forecast with an interval from the quantiles of its validation errors."""
    gens = SEARCH_LEVELS.get(level, 5)
    grid = [float(a) for a in np.linspace(0.05, 0.95, 2 + gens)]

    def cands():
        c = {f"ets_a{a:.2f}": (lambda y, hh, a=a: (K.ses(y, a)[0] * np.ones(hh), f"ses({a:.2f})")) for a in grid}
        for p in range(0, min(gens, 3) + 1):
            for d in (0, 1):
                c[f"arima_{p}{d}0"] = (lambda y, hh, p=p, d=d: (K.arima_forecast(y, hh, p, d), f"arima({p},{d},0)"))
        c["theta"] = lambda y, hh: K.theta_forecast(y, hh, tuple(grid))
        return c

    def fn(pdf):
        y = pdf["_y"].to_numpy(dtype=float)
        if len(y) < max(50, (n_validations + 1) * h + 10):
            return pd.DataFrame({"best": ["series too short"], "mae": [None], "step": [len(y)], "forecast": [None],
                                 "lower": [None], "upper": [None]})
        res = {}
        for name, f in cands().items():
            errs = []
            try:
                for v in range(n_validations, 0, -1):
                    cut = len(y) - v * h
                    pred, _ = f(y[:cut], h)
                    errs.append(y[cut:cut + h] - pred)
            except (np.linalg.LinAlgError, ValueError):
                continue
            e = np.concatenate(errs)
            res[name] = (float(np.mean(np.abs(e))), e)
        best = min(res, key=lambda k: (res[k][0], k))
        f, _ = cands()[best](y, h)
        lo_q, hi_q = np.quantile(res[best][1], [(1 - interval) / 2, 1 - (1 - interval) / 2])
        return pd.DataFrame({"best": best, "mae": res[best][0], "step": np.arange(len(y), len(y) + h),
                             "forecast": f, "lower": f + lo_q, "upper": f + hi_q})
    return _per_series(series, time_col, value_col, series_cols, fn,
                       "best string, mae double, step long, forecast double, lower double, upper double")


# ----------------------------------------------------- window forecasters

def _tail(d: DataFrame, time_col: str, keys, n: int) -> DataFrame:
    """The last n rows of every series with ``_pos`` and ``_len`` (distributed
    positions, no per-series window)."""
    p = global_position(d, keys, [time_col])
    lens = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    p = null_safe_join(p, lens, keys) if keys else p.withColumn("_len", F.lit(lens.first()["_len"]))
    return p.where(F.col("_pos") >= F.col("_len") - n)


def window_forecast(series: DataFrame, time_col: str, value_col: str, series_cols=(), model: str = "rf",
                    n_lags: int = DEFAULT_LAGS, h: int = DEFAULT_H, seed: int = 42) -> DataFrame:
    """Global tree model on ``n_lags`` lags (rows i < len - h, as the reference
    trains), then h recursive rounds starting from the last n_lags values of
    every series. ``model``: "rf" (100 trees, depth 5) or "gbt" (100 rounds,
    depth 3 - the stand-in for the boosted-tree library)."""
    keys = list(series_cols)
    series = cut_lineage(series.select(*keys, time_col, value_col))
    lf = lag_features(series, time_col, value_col, n_lags, h, series_cols=keys)
    feats = [f"lag_{k}" for k in range(1, n_lags + 1)]
    tr = cut_lineage(features_vector(lf, feats).withColumnRenamed("y", "_label"))
    est = (RandomForestRegressor(numTrees=100, maxDepth=5, seed=seed, labelCol="_label") if model == "rf"
           else GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.3, seed=seed, labelCol="_label"))
    m = est.fit(tr)
    # the last n_lags values of every series (a bounded tail per series)
    tail = _tail(series.where(F.col(value_col).isNotNull()), time_col, keys, n_lags)
    state = tail.groupBy(*keys, "_len").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_pos").alias("t"), F.col(value_col).cast("double").alias("v")))).alias("_s"))
    state = cut_lineage(state.select(*keys, F.transform("_s", lambda s: s["v"]).alias("_hist"), "_len"))
    outs = []
    for step in range(h):
        x = state.select(*keys, "_hist", "_len", *[F.col("_hist")[n_lags - k].alias(f"lag_{k}") for k in range(1, n_lags + 1)])
        p = m.transform(features_vector(x, feats)).select(*keys, "_hist", "_len", F.col("prediction").alias("_p"))
        # one row per series: checkpointing keeps every round's plan short
        state = cut_lineage(p.select(*keys, F.slice(F.concat("_hist", F.array("_p")), 2, n_lags).alias("_hist"), "_len"))
        outs.append(state.select(*keys, (F.col("_len") + step).alias("step"), F.element_at("_hist", -1).alias("forecast")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def direct_multi_forecast(series: DataFrame, time_col: str, value_col: str, series_cols=(),
                          n_lags: int = 10, h: int = DEFAULT_H) -> DataFrame:
    """Min-max scaled window of n_lags values -> next h values with h linear
    models sharing the features (one per horizon step), one global model per
    step over all series; the forecast is scaled back per series."""
    keys = list(series_cols)
    series = cut_lineage(series.select(*keys, time_col, value_col))
    ds, mm = multi_horizon_dataset(series, time_col, value_col, n_lags, h, keys)
    mm = cut_lineage(mm)
    feats = [f"x{i}" for i in range(n_lags)]
    base = cut_lineage(ds.select(*keys, *[F.col("x")[i].alias(f"x{i}") for i in range(n_lags)], "y"))
    models = []
    for j in range(h):
        tr = features_vector(base.withColumn("_label", F.col("y")[j]), feats)
        models.append(LinearRegression(labelCol="_label", regParam=0.0, solver="normal").fit(tr))
    d = series.where(F.col(value_col).isNotNull()).join(mm, keys) if keys else \
        series.where(F.col(value_col).isNotNull()).withColumns({k: F.lit(v) for k, v in mm.first().asDict().items()})
    sc = (F.col(value_col) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    tail = _tail(d.withColumn("_v", sc).drop("_len"), time_col, keys, n_lags)
    last = tail.groupBy(*keys, "_lo", "_hi", "_len").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_pos").alias("t"), F.col("_v").alias("v")))).alias("_s"))
    x = last.select(*keys, "_lo", "_hi", "_len", *[F.col("_s")[i]["v"].alias(f"x{i}") for i in range(n_lags)])
    xv = cut_lineage(features_vector(x, feats))
    outs = []
    for j, m in enumerate(models):
        p = m.transform(xv)
        span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
        outs.append(p.select(*keys, (F.col("_len") + j).alias("step"),
                             (F.col("prediction") * span + F.col("_lo")).alias("forecast")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def forecast_table(series: DataFrame, forecast: DataFrame, time_col: str, value_col: str, series_cols=()) -> DataFrame:
    """History rows (kind 'history', position index) + forecast rows (kind 'forecast')."""
    keys = list(series_cols)
    hist = (global_position(series.where(F.col(value_col).isNotNull()), keys, [time_col])
            .select(*keys, F.col("_pos").cast("long").alias("step"),
                    F.col(value_col).cast("double").alias("value"), F.lit("history").alias("kind")))
    fc = forecast.select(*keys, F.col("step").cast("long"), F.col("forecast").alias("value"), F.lit("forecast").alias("kind"))
    return hist.unionByName(fc)
