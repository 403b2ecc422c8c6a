"""Student's t distribution on vectors: the incomplete beta function by its continued fraction, quantiles by bisection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / fix(1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / fix(1 + num * d), fix(1 + num / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1)))
    near = x < (a + 1) / (a + b + 2)
    out = np.where(near, front * _beta_fraction(a, b, np.where(near, x, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(near, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def cdf(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return np.where(t > 0, 1 - tail, tail)


def ppf(q, df) -> np.ndarray:
    q, df = np.broadcast_arrays(np.asarray(q, float), np.asarray(df, float))
    low, high = np.full(q.shape, -1e6), np.full(q.shape, 1e6)
    for _ in range(200):
        mid = (low + high) / 2
        less = cdf(mid, df) < q
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = np.where(np.isinf(t[ok]), (t[ok] > 0).astype(float), cdf(np.clip(t[ok].astype(float), -1e12, 1e12), df[ok]))
    return out


@F.pandas_udf(DoubleType())
def t_ppf(q: pd.Series, df: pd.Series) -> pd.Series:
    ok = q.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=q.index)
    if ok.any():
        out[ok] = ppf(q[ok].astype(float), df[ok])
    return out
