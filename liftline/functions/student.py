"""Student's t and Pearson p-values: the regularised incomplete beta function by its continued fraction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def beta_share(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):  # modified Lentz evaluation
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        value *= c * d
        if k and abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def t_quantile(p: float, df: float) -> float:
    """The t with two-sided p-value 2 * (1 - p), for p > 0.5, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > 2 * (1 - p) else (low, middle)
    return (low + high) / 2


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """For a 95 % interval."""
    return pd.Series([t_quantile(0.975, b) if pd.notna(b) and b > 0 else None for b in df], dtype="float64")


@pandas_udf(DoubleType())
def r_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Of Pearson's r over n pairs."""
    out = []
    for a, b in zip(r, n, strict=True):
        fine = pd.notna(a) and b > 2
        out.append(None if not fine else 0.0 if abs(a) >= 1 else t_tail(a * math.sqrt((b - 2) / (1 - a * a)), b - 2))
    return pd.Series(out, dtype="float64")
