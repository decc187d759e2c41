"""Student t: distribution function and two-sided critical value, for rows of aggregate size."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Degrees of freedom from which on series in their reciprocal are used; the rest of the series is below 1e-13 there.
MANY = 1e4


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 4e-16):
            return h
    raise ArithmeticError("the incomplete beta function doesn't converge")


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """I_x(a, b); y: 1 - x, where it is known better than by subtraction."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, 1 - np.asarray(x, float) if y is None else y)))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.where(x > 0.5, np.log1p(-y), np.log(x)) + b * np.where(y > 0.5, np.log1p(-x), np.log(y)))
    low = x < (a + 1) / (a + b + 2)
    # each side is worked out where it converges
    direct = front * _beta_fraction(a, b, np.where(low, x, 0)) / a
    mirrored = 1 - front * _beta_fraction(b, a, np.where(low, 0, y)) / b
    return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, np.where(low, direct, mirrored)))


def _outside(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    few = np.minimum(df, MANY)
    exact = regularized_beta(few / 2, np.full_like(few, 0.5), few / (few + t * t), t * t / (few + t * t))
    # Fisher's series of the distribution function about the normal one
    n = np.maximum(df, MANY)
    normal = np.vectorize(lambda x: math.erfc(x / math.sqrt(2)), otypes=[float])(np.abs(t))
    z = np.abs(t)
    terms = (z**3 + z) / (4 * n) + (3 * z**7 - 7 * z**5 - 5 * z**3 - 3 * z) / (96 * n**2) + (z**11 - 11 * z**9 + 14 * z**7 + 6 * z**5 - 3 * z**3 - 15 * z) / (384 * n**3)
    series = normal + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * terms
    return np.where(df < MANY, exact, series)


def cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t = np.asarray(t, float)
    tail = _outside(t, df) / 2
    return np.where(t >= 0, 1 - tail, tail)


def critical(level: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t with P(|T| <= t) = level: by bisection on the two tails, for many degrees of freedom by the series about the normal value."""
    level, df = np.broadcast_arrays(np.asarray(level, float), np.asarray(df, float))
    few = np.where(df < MANY, df, 1.0)
    lo, hi = np.zeros_like(few), np.ones_like(few)
    for _ in range(200):
        wide = _outside(hi, few) > 1 - level
        if not wide.any():
            break
        hi = np.where(wide, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        more = _outside(mid, few) > 1 - level
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    n = np.maximum(df, MANY)
    z = -np.vectorize(NormalDist().inv_cdf, otypes=[float])((1 - level) / 2)
    series = (
        z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n**3)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * n**4)
    )
    return np.where(df < MANY, (lo + hi) / 2, series)


def t_critical(level: Column, df: Column) -> Column:
    """Critical value column; null where an argument is null or df isn't positive."""

    @F.pandas_udf("double")
    def batch(levels: pd.Series, dfs: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=levels.index)
        ok = levels.notna() & dfs.notna() & (dfs > 0)
        if ok.any():
            pairs = pd.DataFrame({"l": levels[ok], "d": dfs[ok]})
            distinct = pairs.drop_duplicates()
            found = pd.Series(critical(distinct["l"], distinct["d"]), index=pd.MultiIndex.from_frame(distinct))
            out[ok] = found.loc[pd.MultiIndex.from_frame(pairs)].to_numpy()
        return out.where(ok)

    value = batch(level, df)
    return F.when(~F.isnan(value), value)
