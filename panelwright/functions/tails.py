"""Tail probabilities in plain numpy, for small result tables.

Each kernel works on arrays; the ``*_udf`` wrappers apply them to columns of
result DataFrames (one row per hypothesis or model pair).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(z):
    z = np.asarray(z, dtype=float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    """Inverse normal by bisection on the exact CDF."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the standard continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def chi2_tail(x: float, df: int) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k successes in n fair trials."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2.0) for i in range(n + 1)]
    at = logs[k]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= at + 1e-7))


def kolmogorov_tail(d: float, n1: int, n2: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value (limit law with small-sample correction)."""
    if d is None or min(n1, n2) <= 0:
        return 1.0
    en = math.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    if x < 0.18:
        return 1.0
    total, sign = 0.0, 1.0
    for j in range(1, 200):
        term = math.exp(-2.0 * j * j * x * x)
        total += sign * term
        if term < 1e-18:
            break
        sign = -sign
    return max(0.0, min(1.0, 2.0 * total))


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, df)])


@F.pandas_udf(T.DoubleType())
def binomial_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(a), int(b)) for a, b in zip(k, n)])


@F.pandas_udf(T.DoubleType())
def kolmogorov_udf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_tail(a, int(b), int(c)) for a, b, c in zip(d, n1, n2)])
