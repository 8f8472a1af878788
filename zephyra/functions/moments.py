"""Aggregate expressions for moments and correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unbiased_skewness(column: Column) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for a constant."""
    n = F.count(column).cast("double")
    g1 = F.skewness(column)
    corrected = F.sqrt(n * (n - 1)) / (n - 2) * g1
    return F.when(n > 2, F.when(F.min(column) == F.max(column), 0.0).otherwise(corrected))


def unbiased_kurtosis(column: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, 0 for a constant."""
    n = F.count(column).cast("double")
    g2 = F.kurtosis(column)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.when(F.min(column) == F.max(column), 0.0).otherwise(corrected))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known; NULL when one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
