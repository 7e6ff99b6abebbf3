"""Date and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(text: Column) -> Column:
    """Calendar day written in a timestamp text; no zone shift, invalid text is null."""
    return F.substring(text, 1, 10).try_cast("date")


def parse_timestamp(text: Column) -> Column:
    """Lenient parse: invalid text is null."""
    return F.try_to_timestamp(text)


def drop_zone(ts: Column) -> Column:
    """Wall-clock time of a timestamp in the session zone (UTC)."""
    return ts.cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(end, start)


def plus_years(day: Column, years: int) -> Column:
    """Calendar years later; 29 February becomes 28 February in a short year."""
    return F.add_months(day, 12 * years)


def plus_years_at(ts: Column, years: int) -> Column:
    """As ``plus_years`` for a timestamp: the time of day is kept."""
    return ts + F.make_ym_interval(F.lit(years), F.lit(0))


def age_years(birth: Column, at: Column, offset: int = 0) -> Column:
    """Age in years of 365 days, rounded down (also below zero), plus ``offset``."""
    return (F.floor(F.datediff(at, birth) / F.lit(365)) + F.lit(offset)).cast("int")
