"""Calendar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | date) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def weekly_cutoff(as_of: Column | date) -> Column:
    """The latest Tuesday on or before ``as_of``."""
    day = as_column(as_of)
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(1), F.lit(7)))


def parse_day(text: Column, pattern: str) -> Column:
    """Text to date; text that does not fit the pattern gives NULL, also under ANSI mode."""
    return F.try_to_date(text, pattern)
