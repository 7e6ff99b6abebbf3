"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to double, null where it is no number.

    Java accepts a type suffix (``1d``, ``1f``); such text is no number here.
    NaN becomes null so that means, medians and maxima ignore it.
    """
    trimmed = F.trim(text)
    suffixed = F.lower(F.right(trimmed, F.lit(1))).isin("d", "f")
    return F.nullif(F.when(~suffixed, trimmed.try_cast("double")), F.lit(float("nan")))


def natural_log(x: Column) -> Column:
    """Natural logarithm; null at or below zero."""
    return F.ln(x)


def floor_int(x: Column) -> Column:
    return F.floor(x).cast("int")


def ceil_int(x: Column) -> Column:
    return F.ceil(x).cast("int")


def count_true(*flags: Column) -> Column:
    """How many flags hold in a row; a null flag does not hold."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag.cast("int"), F.lit(0))
    return total


def fill_constant(x: Column, value: int = 0) -> Column:
    """Null to a constant, then integer."""
    return F.coalesce(x, F.lit(value)).cast("int")
