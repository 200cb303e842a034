"""Sample statistics in the adjusted forms that data-frame libraries report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .roles import dbl


def sample_skewness(column: str) -> Column:
    """Bias-adjusted skewness G1; null under three values, zero for a constant column."""
    x = dbl(column)
    n = F.count(x).cast("double")
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(adjusted)


def sample_kurtosis(column: str) -> Column:
    """Adjusted excess kurtosis G2; null under four values, zero for a constant column."""
    x = dbl(column)
    n = F.count(x).cast("double")
    adjusted = ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n < 4, None).when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(adjusted)
