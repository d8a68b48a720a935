"""Row and value repair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.functions import fixed_values
from trendline.functions.dates import as_column, weekly_cutoff


@dataclass(frozen=True)
class LineList:
    """Where a line list keeps its facts and which rows count as cases."""

    event_date: str = "event_date"
    reported_date: str = "reported_date"
    outcome: str = "outcome"
    age: str = "age"
    outcome_text: str = fixed_values.OUTCOME_TEXT
    earliest_event: date = fixed_values.EARLIEST_EVENT

    def event(self) -> Column:
        return F.to_date(F.col(self.event_date))

    def reported(self) -> Column:
        return F.to_date(F.col(self.reported_date))

    def falls_back(self) -> Column:
        """No usable event date: it is missing or before the earliest one allowed."""
        return self.event().isNull() | (self.event() < F.lit(self.earliest_event))

    def case_date(self) -> Column:
        return F.when(self.falls_back(), self.reported()).otherwise(self.event())

    def is_case(self, as_of: Column | date) -> Column:
        """The outcome counts and the case lies before the weekly cut-off."""
        counts = F.col(self.outcome).contains(self.outcome_text)
        return counts & (self.case_date() < weekly_cutoff(as_of))


def clean_line_list(lines: DataFrame, facts: LineList, as_of: Column | date) -> DataFrame:
    """The cases before the cut-off: their repaired event date and their age."""
    return lines.filter(facts.is_case(as_of)).select(
        facts.case_date().alias(facts.event_date), facts.age
    )


def fill_numeric_nulls(df: DataFrame) -> DataFrame:
    """0 for NULL in every numeric column; other columns stay as they are."""
    return df.na.fill(0)


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns in byte order of their names."""
    return df.select(*[F.col(f"`{name}`") for name in sorted(df.columns)])


def date_spine(df: DataFrame, column: str, name: str = "Date") -> DataFrame:
    """The distinct known dates of a column."""
    return df.select(F.col(column).alias(name)).distinct().na.drop()


def drop_footer(df: DataFrame, order: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """All rows but the last one by ``order``, the footer of a sheet.

    Where a frame holds several sheets, ``partition_by`` tells them apart, and each loses its own
    footer. The last rows come from an aggregation, one per sheet.
    """
    if not partition_by:
        return df.filter(F.col(order) < df.agg(F.max(order)).scalar())
    names = {name: f"_sheet_{number}" for number, name in enumerate(partition_by)}
    last = df.groupBy(*[F.col(name).alias(own) for name, own in names.items()]).agg(
        F.max(order).alias("_last")
    )
    same = [F.col(name).eqNullSafe(F.col(own)) for name, own in names.items()]
    return df.join(last, [*same, F.col(order) < F.col("_last")], "left_semi")


def before(df: DataFrame, column: str, limit: Column | date) -> DataFrame:
    """Rows strictly before a date; rows without a date go."""
    return df.filter(F.col(column) < as_column(limit))
