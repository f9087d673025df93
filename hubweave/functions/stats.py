"""Column expressions and small numeric functions shared by the operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Rank within ``by``, ties sharing the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    low = F.rank().over(Window.partitionBy(*by).orderBy(order))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def min_rank(value: str, *by: str) -> Column:
    """Rank by falling value within ``by``, ties sharing the first of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc()))


def z_score(value: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def clean(name: str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def rounded(df, digits: int = 6):
    return df.select(*[clean(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])



def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1 - front * _beta_continued_fraction(b, a, 1 - x) / b


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t."""
    return np.array([np.nan if not (np.isfinite(a) and b > 0) else incomplete_beta(b / 2, 0.5, b / (b + a * a)) for a, b in zip(t, df, strict=True)])
