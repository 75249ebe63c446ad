"""Distribution functions that Spark has no built-in for, as plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if math.isnan(x) or a <= 0 or b <= 0:
        return math.nan
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, f = 1.0, d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return betainc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    """Two-sided p-value of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-values; NULL where either is missing."""
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided normal p-values; NULL where missing."""
    return z.map(lambda v: normal_two_sided(v) if pd.notna(v) else None).astype("float64")


def u_exact_table(n1: int, n2: int) -> np.ndarray:
    """Number of arrangements of two samples for each value of U."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # ranks taken into the first sample
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n2:
                ways[i, shift:] += ways[i - 1, : n1 * n2 + 1 - shift] if shift else ways[i - 1]
    return ways[n1]
