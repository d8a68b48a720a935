"""Counts per date and age band."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.functions import fixed_values


@dataclass(frozen=True)
class Band:
    """A closed range of whole years and how far back its change looks."""

    label: str
    low: int
    high: int
    change_rows: int = fixed_values.AVERAGE_ROWS

    @property
    def sum(self) -> str:
        return f"age_group_{self.label}_sum"

    @property
    def cumulative(self) -> str:
        return f"age_group_{self.label}_cumulative"

    @property
    def average(self) -> str:
        return f"age_group_{self.label}_avg7day"

    @property
    def change(self) -> str:
        return f"diff_{self.average}"

    def holds(self, age: Column) -> Column:
        return age.between(self.low, self.high)


AGE_BANDS = tuple(
    Band(label, low, high, fixed_values.CHANGE_ROWS[label])
    for label, low, high in fixed_values.AGE_BANDS
)


def band_counts(bands: Sequence[Band], age: Column, counted: Column | None = None) -> list[Column]:
    """One conditional count per band; NULL where no row falls into the band."""
    counted = F.lit(True) if counted is None else counted
    return [F.sum(F.when(counted & band.holds(age), 1)).alias(band.sum) for band in bands]


def band_daily_counts(
    cases: DataFrame,
    bands: Sequence[Band],
    date_column: str = "event_date",
    age_column: str = "age",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """One row per date (and segment) with the number of cases in every band.

    The counts are partial sums in each task before the shuffle, so a date that
    holds a third of all cases costs one row per task.
    """
    return cases.groupBy(*partition_by, date_column).agg(*band_counts(bands, F.col(age_column)))
