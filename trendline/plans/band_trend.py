"""The trend table per age band.

``calendar`` reads the line list once and turns all its dates into one table
with a row per date in a single aggregation. On it, ``band_trend`` is the whole
job without any join between series and spines. The step functions do the same
on any daily series and any spine of dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.functions.dates import weekly_cutoff
from trendline.operators import series
from trendline.operators.bands import AGE_BANDS, Band, band_counts
from trendline.operators.cleaning import LineList, before, sorted_columns

DATE = "Date"


def band_cumulative(
    daily: DataFrame, bands: Sequence[Band], order: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    return series.cumulative(
        daily, order, {band.sum: band.cumulative for band in bands}, partition_by
    )


def spine_filled(totals: DataFrame, spine: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """Running totals on every date of the spine."""
    complete = series.complete_dates(totals, spine, DATE)
    filled = series.forward_fill(complete, DATE, [band.cumulative for band in bands])
    return sorted_columns(filled.na.fill(0))


def band_averages(filled: DataFrame, bands: Sequence[Band]) -> DataFrame:
    return sorted_columns(
        series.row_average(filled, DATE, {band.cumulative: band.average for band in bands})
    )


def reported_changes(
    averages: DataFrame,
    reported: DataFrame,
    bands: Sequence[Band],
    as_of: Column | date,
    zero_is_missing: bool = True,
) -> DataFrame:
    """How the averages changed, counted in dates on which anything was reported.

    Only reported dates before the cut-off take part. Where a date has no
    average, or an average of 0, the last other one stands in.
    """
    reported = before(reported, DATE, weekly_cutoff(as_of))
    columns = [band.average for band in bands]
    tracked = averages.select(DATE, *columns, F.lit(True).alias("_in_series")).join(
        reported, DATE, "right"
    )
    filled = series.forward_fill(tracked, DATE, columns, zero_is_missing=zero_is_missing)
    changes = series.lagged_change(
        filled, DATE, {band.average: (band.change, band.change_rows) for band in bands}
    )
    return changes.filter("_in_series").select(DATE, *[band.change for band in reversed(bands)])


def calendar(
    lines: DataFrame,
    facts: LineList,
    bands: Sequence[Band],
    as_of: Column | date,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """One row per date found anywhere in the line list.

    ``_on_spine`` tells the dates of any event, ``_reported`` those of any
    report, ``_cases`` counts the cases dated there. A line marks its event date
    and its report date, and its case lands on one of the two, so both marks
    aggregate in each task before the only shuffle.
    """
    case, falls_back = facts.is_case(as_of), facts.falls_back()
    lines = lines.select(
        *partition_by,
        F.col(facts.age).alias("_age"),
        F.array(
            F.struct(
                facts.event().alias(DATE),
                F.lit(True).alias("_on_spine"),
                F.lit(False).alias("_reported"),
                (case & ~falls_back).alias("_case"),
            ),
            F.struct(
                facts.reported().alias(DATE),
                F.lit(False).alias("_on_spine"),
                F.lit(True).alias("_reported"),
                (case & falls_back).alias("_case"),
            ),
        ).alias("_marks"),
    )
    # Both marks always exist; the outer form keeps Spark from testing for empty arrays.
    marks = lines.select(*partition_by, "_age", F.inline_outer("_marks"))
    marks = marks.filter(F.col(DATE).isNotNull())
    return marks.groupBy(*partition_by, DATE).agg(
        F.max("_on_spine").alias("_on_spine"),
        F.max("_reported").alias("_reported"),
        F.count_if("_case").alias("_cases"),
        *band_counts(bands, F.col("_age"), F.col("_case")),
    )


def band_trend(
    lines: DataFrame,
    as_of: Column | date,
    facts: LineList | None = None,
    bands: Sequence[Band] = AGE_BANDS,
    zero_is_missing: bool = True,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Per date and band: cases, running total, seven-row average and its change.

    Rows are the dates of events and cases, at and after the cut-off too. The
    change is NULL on dates without a report and from the cut-off on.
    ``partition_by`` gives every segment a table of its own.
    """
    days = calendar(lines, facts or LineList(), bands, as_of, partition_by)
    days = days.withColumns(
        {
            "_in_series": F.col("_on_spine") | (F.col("_cases") > 0),
            "_tracked": F.col("_reported") & (F.col(DATE) < weekly_cutoff(as_of)),
        }
    )
    # Days of reports only carry no cases, so they pass the running totals on unchanged.
    totals = band_cumulative(days, bands, DATE, partition_by).na.fill(
        0, [name for band in bands for name in (band.sum, band.cumulative)]
    )
    averages = series.row_average(
        totals,
        DATE,
        {band.cumulative: band.average for band in bands},
        partition_by=[*partition_by, "_in_series"],
    ).withColumns({_work(band): F.when(F.col("_in_series"), F.col(band.average)) for band in bands})
    tracked = [*partition_by, "_tracked"]
    filled = series.forward_fill(
        averages, DATE, [_work(band) for band in bands], tracked, zero_is_missing
    )
    changes = series.lagged_change(
        filled,
        DATE,
        {_work(band): (band.change, band.change_rows) for band in bands},
        tracked,
    )
    wide = sorted(n for band in bands for n in (band.sum, band.cumulative, band.average))
    return changes.filter("_in_series").select(
        *partition_by,
        DATE,
        *wide,
        *[F.when(F.col("_tracked"), F.col(b.change)).alias(b.change) for b in reversed(bands)],
    )


def daily_counts(days: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """The counts per band out of a calendar, on the dates that have cases."""
    return days.filter(F.col("_cases") > 0).select(DATE, *[band.sum for band in bands])


def event_dates(days: DataFrame) -> DataFrame:
    return days.filter("_on_spine").select(DATE)


def report_dates(days: DataFrame) -> DataFrame:
    return days.filter("_reported").select(DATE)


def _work(band: Band) -> str:
    return f"_{band.average}"
