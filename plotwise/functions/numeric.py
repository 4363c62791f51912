"""Numeric Column helpers: ANSI-safe division, half-even rounding and the
bias-corrected sample moments (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """Division that yields null on a zero or null divisor (ANSI-safe)."""
    return F.try_divide(col_(a), col_(b))


def half_even(c, scale: int = 0) -> Column:
    """Banker's rounding, the rounding of numpy/pandas ``round``."""
    return F.bround(col_(c), scale)


def derive_area(price, rate, crore: float = 1e7) -> Column:
    """area = round_half_even(price * 1e7 / price_per_sqft)."""
    return half_even(safe_div(col_(price) * F.lit(float(crore)), rate), 0)


def price_per_sqft(price, area, crore: float = 1e7) -> Column:
    """P4 inverse: rate = round_half_even(price * 1e7 / area)."""
    return half_even(safe_div(col_(price) * F.lit(float(crore)), area), 0)


def log_target(c) -> Column:
    """P5: log1p."""
    return F.log1p(col_(c))


def unlog_target(c) -> Column:
    """P5 inverse: expm1."""
    return F.expm1(col_(c))


def sample_skew(c) -> Column:
    """A10: bias-corrected sample skewness (pandas ``skew``) as one aggregate.

    Spark's ``skewness`` is the population g1; G1 = sqrt(n(n-1))/(n-2) * g1.
    """
    x = col_(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def sample_kurt(c) -> Column:
    """A10: bias-corrected sample excess kurtosis (pandas ``kurt``).

    G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6) with g2 Spark's population kurtosis.
    """
    x = col_(c)
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
