"""Tail probabilities for the tests on small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_one_tail(statistic: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, freedom: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))


@F.pandas_udf(T.DoubleType())
def chi2_tail_column(statistic: pd.Series) -> pd.Series:
    return statistic.map(chi2_one_tail, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def student_tail_column(t: pd.Series, freedom: pd.Series) -> pd.Series:
    values = [
        student_two_sided(a, f) if pd.notna(a) and pd.notna(f) else None for a, f in zip(t, freedom)
    ]
    return pd.Series(values, dtype="float64")
