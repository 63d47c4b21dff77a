"""Rounding and safe arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round once, on decimals, half away from zero, as numeric rounding in the source database does."""
    return F.round(col(c).cast("decimal(30,10)"), digits).cast("double")


def js_round(c: Column | str) -> Column:
    """Math.round of JavaScript: floor(x + 0.5)."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero divisor."""
    return F.try_divide(a, b)


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Full 24-hour periods between two timestamps (not calendar days)."""
    gap = col(later) - col(earlier)
    return F.extract(F.lit("DAY"), gap).cast("int")
