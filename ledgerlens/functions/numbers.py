"""Numeric column expressions: safe division, rounding, moments, formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def as_double(col: Column) -> Column:
    return col.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL, not an error, for a zero denominator."""
    return F.try_divide(as_double(numerator), as_double(denominator))


def ratio_or(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    return F.when(denominator > 0, ratio(numerator, denominator)).otherwise(F.lit(float(default)))


def rounded(col: Column, digits: int) -> Column:
    """Half-up rounding after removing floating noise four digits further down.

    Rounding in two steps makes the result independent of the order in which
    partial sums were added up on the executors.
    """
    return F.round(F.round(as_double(col), digits + 4), digits)


def finite(col: Column) -> Column:
    """NULL for NaN and the infinities."""
    value = as_double(col)
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def finite_or_zero(col: Column) -> Column:
    return F.coalesce(finite(col), F.lit(0.0))


def adjusted_skewness(n: Column, g1: Column) -> Column:
    """Sample skewness G1 from the biased g1."""
    n = as_double(n)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis G2 from the biased g2."""
    n = as_double(n)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def k_squared(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson omnibus statistic from the count and the biased moments.

    Closed form over the whole column (D'Agostino and Pearson 1973; Anscombe
    and Glynn 1983), so it needs one aggregation pass and no sample.
    """
    n = as_double(n)
    skew_z_arg = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z_skew = F.asinh(skew_z_arg / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / F.sqrt(variance)
    moment = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / moment * (2 / moment + F.sqrt(1 + 4 / (moment * moment)))
    z_kurt = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z_skew * z_skew + z_kurt * z_kurt)


def short_money(col: Column) -> Column:
    """``$1.2M`` / ``$3.4K`` / ``$5.60``."""
    value = as_double(col)

    def with_digits(c: Column, digits: int) -> Column:
        return F.regexp_replace(F.format_number(c, digits), ",", "")

    return (
        F.when(value >= 1_000_000, F.concat(F.lit("$"), with_digits(value / 1_000_000, 1), F.lit("M")))
        .when(value >= 1_000, F.concat(F.lit("$"), with_digits(value / 1_000, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), with_digits(value, 2)))
    )


def percent_text(col: Column, digits: int = 1) -> Column:
    return F.concat(F.regexp_replace(F.format_number(as_double(col), digits), ",", ""), F.lit("%"))


def grouped_text(col: Column, digits: int = 0) -> Column:
    """Number with thousands separators."""
    return F.format_number(as_double(col), digits)


def plain_text(col: Column, digits: int) -> Column:
    """Fixed-point text without thousands separators."""
    return F.regexp_replace(F.format_number(as_double(col), digits), ",", "")
