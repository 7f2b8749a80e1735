"""Tail probabilities for test statistics (chi-square, Student t, normal).

Applied as an Arrow-batched pandas UDF to already-aggregated rows (one row
per test), never to raw data.  Series expansions / continued fractions from
Numerical Recipes-style algorithms; accuracy ~1e-12 for the ranges used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1:
        term = s = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - lg))
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    bt = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                  + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1 - bt * _betacf(b, a, 1 - x) / b


def chi2_sf(stat: float, dof: float) -> float:
    if stat is None or dof is None or dof <= 0 or math.isnan(stat):
        return float("nan")
    return _gammaincc(dof / 2.0, stat / 2.0)


def t_sf_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    return _betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_sf_two_sided(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(s, d) for s, d in zip(stat, dof)], dtype=np.float64)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_sf_two_sided(a, d) for a, d in zip(t, dof)], dtype=np.float64)


@F.pandas_udf(DoubleType())
def z_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_sf_two_sided(a) for a in z], dtype=np.float64)
