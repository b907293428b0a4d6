"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(column: str | Column) -> Column:
    """NaN and null both become null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ratio(a: Column, b: Column) -> Column:
    """Quotient that is null instead of an error when the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# Coefficients of the Chebyshev fit of erfc, relative error below 1.2e-7.
ERFC_FIT = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def two_sided_normal(z: Column) -> Column:
    """P(|Z| > z) for z >= 0."""
    x = z / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x / 2.0)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)
