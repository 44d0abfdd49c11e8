"""Per-series numerical kernels (numpy), called inside grouped Arrow maps.

Each function works on ONE series (a 1-d array of a resampled series, whose
length is its number of time bins) and is small and self-contained. Spark
distributes the series; these kernels never see more than one.
"""

from __future__ import annotations

import math

import numpy as np

# ------------------------------------------------------------------- DTW


def dtw(x: np.ndarray, y: np.ndarray, window: int = 0) -> float | None:
    """Cost of the cheapest monotone alignment of two series, |x_i - y_j| per matched pair.

    The cost table is swept one anti-diagonal (i + j = s) at a time: a cell's three
    predecessors lie on the two diagonals before its own, so a diagonal is one
    vector operation and three of them are kept. ``window`` > 0 admits only cells
    with |i - j| <= max(window, |len(x) - len(y)|). None for an empty series.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return None
    reach = max(window, abs(n - m)) if window and window > 0 else n + m
    back = y[::-1]
    older, old = np.full(n, np.inf), np.full(n, np.inf)      # by i, for s - 2 and s - 1
    for s in range(n + m - 1):
        first, last = max(0, s - m + 1, -((reach - s) // 2)), min(n - 1, s, (s + reach) // 2)
        new = np.full(n, np.inf)
        if first <= last:
            here = slice(first, last + 1)
            up = np.concatenate([[np.inf], old])[here]        # (i - 1, j)
            corner = np.concatenate([[np.inf], older])[here]  # (i - 1, j - 1)
            best = np.minimum(np.minimum(up, old[here]), corner)
            if s == 0:
                best[0] = 0.0
            # j = s - i runs down as i runs up
            new[here] = best + np.abs(x[here] - back[m - 1 - s + first:m - s + last])
        older, old = old, new
    return float(old[n - 1])


# ----------------------------------------------------------------- LOESS

def loess(y: np.ndarray, span: int, x_out=None, degree: int = 1, rw=None) -> np.ndarray:
    """Local (degree 0/1) regression with tricube weights over ``span`` nearest
    positions, evaluated at positions ``x_out`` (default 0..n-1)."""
    n = len(y)
    x = np.arange(n, dtype=float)
    xo = x if x_out is None else np.asarray(x_out, dtype=float)
    q = min(span, n)
    out = np.empty(len(xo))
    rw = np.ones(n) if rw is None else rw
    for k, x0 in enumerate(xo):
        lo = int(min(max(0, math.ceil(x0 - (q - 1) / 2)), n - q))
        idx = np.arange(lo, lo + q)
        d = np.abs(x[idx] - x0)
        h = max(d.max(), 1e-12)
        if span > n:
            h += (span - n) / 2.0
        u = np.clip(d / h, 0, 1)
        wt = (1 - u ** 3) ** 3 * rw[idx]
        if wt.sum() <= 0:
            out[k] = y[idx].mean()
            continue
        if degree == 0:
            out[k] = np.sum(wt * y[idx]) / wt.sum()
        else:
            xm = np.sum(wt * x[idx]) / wt.sum()
            ym = np.sum(wt * y[idx]) / wt.sum()
            sxx = np.sum(wt * (x[idx] - xm) ** 2)
            b = np.sum(wt * (x[idx] - xm) * (y[idx] - ym)) / sxx if sxx > 1e-12 else 0.0
            out[k] = ym + b * (x0 - xm)
    return out


def _odd(v: float) -> int:
    v = int(math.ceil(v))
    return v if v % 2 == 1 else v + 1


def stl(y: np.ndarray, period: int = 24, seasonal: int = 7, trend: int | None = None,
        low_pass: int | None = None, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """STL decomposition (Cleveland et al. 1990), non-robust, every point
    evaluated (no jumps). Returns (trend, seasonal, resid); y = T + S + R."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    trend = trend or _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_pass = low_pass or _odd(period + 1)
    T = np.zeros(n)
    S = np.zeros(n)
    for _ in range(inner):
        dt = y - T
        # cycle-subseries smoothing, each subseries extended by one point at both ends
        C = np.zeros(n + 2 * period)
        for s in range(period):
            sub = dt[s::period]
            m = len(sub)
            if m == 0:
                continue
            sm = loess(sub, seasonal, x_out=np.arange(-1, m + 1))
            C[s::period][:m + 2] = sm[:len(C[s::period])]
        # low-pass: MA(p), MA(p), MA(3), LOESS(low_pass)
        L = np.convolve(C, np.ones(period) / period, mode="valid")
        L = np.convolve(L, np.ones(period) / period, mode="valid")
        L = np.convolve(L, np.ones(3) / 3, mode="valid")
        L = loess(L, low_pass)
        S = C[period:period + n] - L[:n]
        T = loess(y - S, trend)
    return T, S, y - T - S


# ------------------------------------------------------- ARIMA (p, d, 0)

def _lagmat(z: np.ndarray, p: int):
    rows = [z[p - k - 1:len(z) - k - 1] for k in range(p)]
    return np.column_stack(rows) if p else np.zeros((len(z) - p, 0))


def arima_fit(y: np.ndarray, p: int = 1, d: int = 1, exog: np.ndarray | None = None) -> dict:
    """ARIMA(p, d, 0) with optional exogenous regressors by conditional least
    squares on the differenced series: dz_t = c + sum phi_k dz_{t-k} + beta x_t."""
    z = np.diff(y, n=d) if d else np.asarray(y, dtype=float)
    X = [np.ones(len(z) - p), _lagmat(z, p)]
    if exog is not None and len(exog):
        ex = np.diff(exog, n=d, axis=0) if d else exog
        X.append(ex[p:])
    X = np.column_stack(X)
    t = z[p:]
    coef, *_ = np.linalg.lstsq(X, t, rcond=None)
    resid = t - X @ coef
    sigma2 = float(np.mean(resid ** 2)) if len(resid) else float("nan")
    k = X.shape[1]
    aic = len(t) * math.log(max(sigma2, 1e-300)) + 2 * k
    return {"p": p, "d": d, "coef": coef, "sigma2": sigma2, "aic": aic, "resid": resid}


def arima_forecast(y: np.ndarray, h: int, p: int = 1, d: int = 1, exog=None, exog_future=None) -> np.ndarray:
    y = np.asarray(y, dtype=float)
    m = arima_fit(y, p, d, exog)
    c, phi = m["coef"][0], m["coef"][1:1 + p]
    beta = m["coef"][1 + p:]
    z = list(np.diff(y, n=d) if d else y)
    ex_hist = None
    if exog is not None and len(beta):
        ex_hist = np.asarray(exog, dtype=float)
        fut = np.asarray(exog_future, dtype=float)
        ex_all = np.vstack([ex_hist, fut])
        ex_d = np.diff(ex_all, n=d, axis=0) if d else ex_all
        ex_f = ex_d[-h:]
    out = []
    for i in range(h):
        v = c + sum(phi[k] * z[-1 - k] for k in range(p))
        if ex_hist is not None:
            v += float(ex_f[i] @ beta)
        z.append(v)
        out.append(v)
    out = np.asarray(out)
    # integrate back d times
    levels = out
    for j in range(d, 0, -1):
        last = np.diff(y, n=j - 1)[-1] if j - 1 else y[-1]
        levels = last + np.cumsum(levels)
    return levels


def auto_arima_forecast(y: np.ndarray, h: int, max_p: int = 2, max_d: int = 1) -> tuple[np.ndarray, str]:
    best = None
    for d in range(0, max_d + 1):
        for p in range(0, max_p + 1):
            if len(y) - d - p < 5:
                continue
            a = arima_fit(y, p, d)["aic"]
            if best is None or a < best[0]:
                best = (a, p, d)
    _, p, d = best
    return arima_forecast(y, h, p, d), f"arima({p},{d},0)"


# --------------------------------------------- exponential smoothing, theta

def ses(y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    level = y[0]
    fitted = np.empty(len(y))
    for i, v in enumerate(y):
        fitted[i] = level
        level = alpha * v + (1 - alpha) * level
    return level, fitted


def holt(y: np.ndarray, alpha: float, beta: float) -> tuple[float, float, np.ndarray]:
    level, trend = y[0], (y[1] - y[0]) if len(y) > 1 else 0.0
    fitted = np.empty(len(y))
    for i, v in enumerate(y):
        fitted[i] = level + trend
        new_level = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        level = new_level
    return level, trend, fitted


GRID = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def ets_forecast(y: np.ndarray, h: int, grid=GRID) -> tuple[np.ndarray, str]:
    """Simple or Holt additive smoothing, parameters by in-sample squared error."""
    best = None
    for a in grid:
        lv, f = ses(y, a)
        e = float(np.mean((y[1:] - f[1:]) ** 2))
        if best is None or e < best[0]:
            best = (e, "ses", a, None, lv, 0.0)
        for b in grid[:4]:
            lv2, tr, f2 = holt(y, a, b)
            e2 = float(np.mean((y[2:] - f2[2:]) ** 2))
            if e2 < best[0]:
                best = (e2, "holt", a, b, lv2, tr)
    _, kind, a, b, lv, tr = best
    return lv + tr * np.arange(1, h + 1), f"ets_{kind}"


def theta_forecast(y: np.ndarray, h: int, grid=GRID) -> tuple[np.ndarray, str]:
    """Theta method: SES forecast plus half the slope of the linear trend."""
    n = len(y)
    t = np.arange(n)
    b0 = np.polyfit(t, y, 1)[0] if n > 1 else 0.0
    best = None
    for a in grid:
        lv, f = ses(y, a)
        e = float(np.mean((y[1:] - f[1:]) ** 2))
        if best is None or e < best[0]:
            best = (e, a, lv)
    _, a, lv = best
    steps = np.arange(1, h + 1)
    return lv + 0.5 * b0 * (steps - 1 + 1 / a - (1 - a) ** n / a), "theta"


CANDIDATES = {"auto_arima": auto_arima_forecast, "auto_ets": ets_forecast, "auto_theta": theta_forecast}


def ridge_season(y: np.ndarray, h: int, period: int = 24, n_fourier: int = 3, n_knots: int = 10,
                 lam: float = 1.0, exog=None, exog_future=None) -> np.ndarray:
    """Additive trend (piecewise linear, knots) + Fourier seasonality + regressors, ridge fit."""
    n = len(y)
    t = np.arange(n + h, dtype=float)
    knots = np.linspace(0, n, n_knots + 2)[1:-1]
    cols = [np.ones(n + h), t / max(n, 1)] + [np.maximum(0, t - k) / max(n, 1) for k in knots]
    for j in range(1, n_fourier + 1):
        cols += [np.sin(2 * np.pi * j * t / period), np.cos(2 * np.pi * j * t / period)]
    X = np.column_stack(cols)
    if exog is not None:
        X = np.column_stack([X, np.vstack([exog, exog_future])])
    A = X[:n]
    reg = lam * np.eye(A.shape[1])
    reg[0, 0] = 0.0
    coef = np.linalg.solve(A.T @ A + reg, A.T @ y)
    return X[n:] @ coef
