"""Quantities as deliveries write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Tokens that stand for no value.
NULL_TOKENS = ["", "-", "N/A", "null"]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def parse_quantity(c: Column) -> tuple[Column, Column]:
    """Decimal value and reason: commas go, null-like tokens are missing (not zero), negative or other texts are rejected.

    A number of more than 14 whole digits is out of range, with a reason of its own.
    """
    plain = F.regexp_replace(F.trim(c), ",", "")
    missing = c.isNull() | F.upper(plain).isin([t.upper() for t in NULL_TOKENS])
    numeric = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    number = F.when(~missing & numeric, plain.try_cast("decimal(20,6)"))
    reason = F.when(missing, "MISSING").when(~numeric, "NOT_NUMERIC").when(plain.startswith("-") & F.coalesce(number != 0, F.lit(True)), "NEGATIVE").when(number.isNull(), "OUT_OF_RANGE")
    return F.when(reason.isNull(), number), reason
