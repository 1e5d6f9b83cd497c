"""Column expressions with the null, zero-division and bias rules used across the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double precision; a zero denominator gives NULL."""
    return numerator.cast("double") / zero_to_null(denominator.cast("double"))


def log1p_floor(value: Column) -> Column:
    """log(1 + max(x, 0)), NULL for NULL."""
    x = value.cast("double")
    return F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; NULL for a constant side."""
    both_a = F.when(b.isNotNull(), a)
    both_b = F.when(a.isNotNull(), b)
    spread = F.stddev_pop(both_a) * F.stddev_pop(both_b)
    return F.covar_pop(a, b) / zero_to_null(spread)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness: NULL below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    factor = F.sqrt(n * (n - 1)) / zero_to_null(n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(x), F.lit(0.0)) * factor)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below four values, 0 for a constant."""
    n = F.count(x).cast("double")
    factor = (n - 1) / zero_to_null((n - 2) * (n - 3))
    raw = F.kurtosis(x)
    return F.when(
        n >= 4, F.when(raw.isNull(), F.lit(0.0)).otherwise(factor * ((n + 1) * raw + 6))
    )


def uniform_edges(low: float | None, high: float | None, bins: int) -> list[float]:
    """Equal-width edges; a constant range is widened by a thousandth on both sides."""
    if low is None or high is None:
        return []
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - margin, high + margin
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def distinct_edges(quantiles: Sequence[float | None]) -> list[float]:
    return sorted({q for q in quantiles if q is not None})
