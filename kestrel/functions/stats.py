"""Scalar statistics evaluated on the driver from a few aggregated numbers.

Nothing here touches rows: inputs are the outputs of one Spark aggregation
(a correlation and a count, L+1 autocovariances, ...).
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float, itmax: int = 300, eps: float = 3e-16) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def corr_pvalue(r, n) -> float | None:
    """Two-sided p-value of a correlation r from n pairs (t test, n - 2 df)."""
    if r is None or n is None or n < 3:
        return None
    r = max(-1.0, min(1.0, float(r)))
    if abs(r) == 1.0:
        return 0.0
    df = n - 2
    return betainc(df / 2.0, 0.5, 1.0 - r * r)


def durbin_levinson(cov) -> list[float]:
    """Partial autocorrelations [1, phi_11, phi_22, ...] from autocovariances."""
    L = len(cov) - 1
    out = [1.0]
    if L < 1 or not cov[0]:
        return out + [float("nan")] * L
    phi_prev: list[float] = []
    v = cov[0]
    for k in range(1, L + 1):
        num = cov[k] - sum(phi_prev[j] * cov[k - 1 - j] for j in range(k - 1))
        pk = num / v
        phi = [phi_prev[j] - pk * phi_prev[k - 2 - j] for j in range(k - 1)] + [pk]
        v = v * (1 - pk * pk)
        phi_prev = phi
        out.append(pk)
    return out
