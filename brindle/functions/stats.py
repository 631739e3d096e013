"""Scalar statistics without scipy: column expressions where Spark has the parts, numpy elsewhere."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the normal quantile.
QNORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QNORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QNORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QNORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def horner(x: str, coefs, last: str = "") -> str:
    out = f"({coefs[0]!r})"
    for c in coefs[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return f"({out} * {x} + {last})" if last else out


def qnorm_sql(p: str) -> str:
    """SQL of the standard normal quantile of p, for Spark and DuckDB alike."""
    tail = lambda q: f"({horner(q, QNORM_C)} / {horner(q, QNORM_D, '1.0')})"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({horner(r, QNORM_A)} * {q} / {horner(r, QNORM_B, '1.0')})"
    return f"(case when {p} < 0.02425 then {tail(low)} when {p} > 0.97575 then -{tail(high)} else {mid} end)"


def qnorm(p: str) -> Column:
    return F.expr(qnorm_sql(p))


def uniform_sql(key: str) -> str:
    """Hash of a string key to [0, 1), the same in Spark."""
    return f"(cast(conv(substr(md5({key}), 1, 8), 16, 10) as bigint) / 4294967296.0D)"


def uniform_duck(key: str) -> str:
    return f"(cast(('0x' || substr(md5({key}), 1, 8)) as bigint) / 4294967296.0)"


def uniform(*parts) -> Column:
    key = F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            out *= step
        if abs(step - 1) < 1e-14:
            break
    return front * out / a


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (df > 0) or t != t:
        return float("nan")
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2x2 table: all tables not likelier than the observed, with relative tolerance 1e-7."""
    r, s, k = a + b, c + d, a + c
    lf = math.lgamma
    logp = lambda x: lf(r + 1) - lf(x + 1) - lf(r - x + 1) + lf(s + 1) - lf(k - x + 1) - lf(s - k + x + 1) - (lf(r + s + 1) - lf(k + 1) - lf(r + s - k + 1))
    lo, hi = max(0, k - s), min(r, k)
    p = np.exp([logp(x) for x in range(lo, hi + 1)])
    return float(min(1.0, p[p <= p[a - lo] * (1 + 1e-7)].sum()))


def bisect_weight_c(g: int, top: float = 0.01, mass: float = 0.20) -> float:
    """c of weights 1/(rank + c) such that the top share of g ranks carries `mass`."""
    n = max(1, round(top * g))
    if n >= g:
        return 1e-6
    ranks = np.arange(1, g + 1)
    share = lambda c: (1 / (ranks[:n] + c)).sum() / (1 / (ranks + c)).sum() - mass
    lo, hi = 1e-6, 1e4 * g
    if share(lo) <= 0:
        return lo
    if share(hi) >= 0:
        return hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if share(mid) > 0 else (lo, mid)
    return (lo + hi) / 2
