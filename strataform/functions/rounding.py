"""Exact decimals: every served figure is rounded half-even at a stated scale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dec(c: Column, precision: int = 20, scale: int = 6) -> Column:
    """Cast to an exact decimal before any arithmetic."""
    return c.cast(f"decimal({precision},{scale})")


def half_even(c: Column, scale: int, precision: int = 20) -> Column:
    """Round half-even and fix the resulting type."""
    return F.bround(c, scale).cast(f"decimal({precision},{scale})")


def ratio(num: Column, den: Column, scale: int, precision: int = 20) -> Column:
    """num / den rounded half-even; null where the denominator is null or zero."""
    return half_even(F.try_divide(num, F.nullif(den, F.lit(0))), scale, precision)


def clamp_score(c: Column) -> Column:
    """Clamp to [0, 100] and round half-even to four places."""
    return half_even(F.greatest(F.lit(0), F.least(F.lit(100), c)), 4, 7)
