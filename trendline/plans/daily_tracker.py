"""Headline figures of the daily tracker and their place in its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendline.functions.names import safe_column_names
from trendline.operators.cleaning import drop_footer
from trendline.operators.kpi import Kpi, kpi_rows, stored_kpi_row

DATE = "Date"

# Names and metrics of the twelve figures, in their order.
DOSES = "daily_dose_count_total"
DOSES_AVERAGE = "doses_administered_7-day_avg"
FIRST_DOSE = "people_w/_at_least_one_dose"
FULL_SERIES = "people_fully_vaccinated"
BOOSTER = "people_w/_fall_booster"
TRACKER_KPIS = (
    Kpi("Cumulative doses", DOSES, "total"),
    Kpi("dailydose_count_total", DOSES, "recent_sum", rows=7),
    Kpi("Daily_Doses_lastdate", DOSES, "latest", null_as_zero=True),
    Kpi("daily_dose_diff_", DOSES, "above_high", null_as_zero=True),
    Kpi("doses_administered_7dayavg", DOSES_AVERAGE, "latest", null_as_zero=True),
    Kpi("daily_dose_diff", DOSES_AVERAGE, "above_high", null_as_zero=True),
    Kpi("people_least1dose", FIRST_DOSE, "latest"),
    Kpi("7day_rolling_min1dose", FIRST_DOSE, "above_low"),
    Kpi("p_fully_vaccinated", FULL_SERIES, "latest"),
    Kpi("7day_fullVac", FULL_SERIES, "above_low"),
    Kpi("people_fall_booster", BOOSTER, "latest"),
    Kpi("Spring/Fall_booster_7dayroll", BOOSTER, "above_low"),
)


def tracker_from_sheet(
    sheet: DataFrame, order: str = "row_idx", workbook: str | None = None
) -> DataFrame:
    """A tracker sheet without its footer row, under safe names, with a date for the time.

    If the sheets of several workbooks were read together, ``workbook`` is the column that tells
    them apart (``path``, as the reader names it); each loses its own footer.
    """
    kept = drop_footer(sheet, order, [workbook] if workbook else [])
    tracker = safe_column_names(kept.drop(order, *([workbook] if workbook else [])))
    return tracker.withColumn(DATE, F.to_date(DATE))


def tracker_kpis(tracker: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The twelve figures of the latest date, under safe names."""
    return safe_column_names(kpi_rows(tracker, DATE, TRACKER_KPIS, partition_by))


def attach_kpis(tracker: DataFrame) -> DataFrame:
    """The tracker with its figures on the row of the latest date, NULL elsewhere.

    The tracker is read several times, so it should be stored.
    """
    figures = safe_column_names(stored_kpi_row(tracker, DATE, TRACKER_KPIS))
    return tracker.join(figures.withColumnRenamed(DATE.lower(), DATE), [DATE], "full")
