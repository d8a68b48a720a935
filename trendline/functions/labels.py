"""Repair of labels that carry dates or ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendline.functions.dates import parse_day

# The shapes of the labels after lower-casing and removal of blanks.
COMPACT_DATE = "^[0-9]{4}([a-z]{3})([0-9]{2})([0-9]{4})"
WEEK_TOKEN = "week[0-9][0-9]"


def week_label_day(label: Column) -> Column:
    """``2020 Week20 May23 2021`` to 2021-05-23.

    The year at the end wins over the one in front. Labels without ``Week`` or
    without a blank give NULL, as do days written with a single digit.
    """
    parts = F.split(F.replace(label, F.lit("Week"), F.lit("")), "[ -]")
    year = F.coalesce(F.get(parts, F.lit(3)), F.get(parts, F.lit(0)))
    day = parse_day(F.concat(year, F.lit(" "), F.get(parts, F.lit(2))), "yyyy MMMdd")
    return F.when(label.contains("Week") & label.contains(" "), day)


def _squeezed(label: Column) -> Column:
    return F.lower(F.replace(label, F.lit(" "), F.lit("")))


def compact_date(label: Column) -> Column:
    """``2020 Jan02 2021`` to ``2021jan02``; labels of another shape stay as they are."""
    squeezed = _squeezed(label)
    rewritten = F.regexp_replace(squeezed, f"(?s){COMPACT_DATE}.*$", "$3$1$2")
    # A rewritten label is shorter, so it differs from what it was made of.
    return F.coalesce(F.nullif(rewritten, squeezed), label)


def strip_week_token(label: Column) -> Column:
    """Lower-case, without blanks and without every ``weekNN``."""
    return F.regexp_replace(_squeezed(label), WEEK_TOKEN, "")


def join_range_label(label: Column) -> Column:
    """``12to17`` to ``12-17``; a label without ``to`` stays as it is, NULL stays NULL."""
    return F.array_join(F.slice(F.split(label, "to"), 1, 2), "-")
