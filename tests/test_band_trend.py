"""The trend table on small line lists with results worked out by hand."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from trendline.functions import weekly_cutoff
from trendline.operators import cleaning, series
from trendline.operators.bands import AGE_BANDS, Band, band_daily_counts
from trendline.operators.cleaning import LineList
from trendline.plans import band_trend as trend

SCHEMA = "event_date date, reported_date date, outcome string, age int"
AS_OF = date(2021, 3, 10)  # a Wednesday
D = date(2021, 1, 1)
ONE_BAND = (Band("all", 0, 200, change_rows=2),)


def day(n):
    return D + timedelta(days=n)


def lines_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stepwise(lines, bands, as_of, zero_is_missing=True):
    """The trend table out of the single steps."""
    cases = cleaning.clean_line_list(lines, LineList(), as_of)
    daily = band_daily_counts(cases, bands).withColumnRenamed("event_date", trend.DATE)
    totals = trend.band_cumulative(daily, bands, trend.DATE)
    filled = trend.spine_filled(totals, cleaning.date_spine(lines, "event_date"), bands)
    averages = trend.band_averages(filled, bands)
    reported = cleaning.date_spine(lines, "reported_date")
    changes = trend.reported_changes(averages, reported, bands, as_of, zero_is_missing)
    return averages.join(changes, trend.DATE, "left")


@pytest.mark.parametrize(
    ("as_of", "cutoff"),
    [
        (date(2021, 3, 8), date(2021, 3, 2)),
        (date(2021, 3, 9), date(2021, 3, 9)),
        (date(2021, 3, 10), date(2021, 3, 9)),
        (date(2021, 3, 14), date(2021, 3, 9)),
    ],
)
def test_cutoff_is_the_latest_tuesday(spark, as_of, cutoff):
    assert spark.range(1).select(weekly_cutoff(as_of)).collect()[0][0] == cutoff


def test_cleaning_falls_back_and_cuts_off(spark):
    cutoff = date(2021, 3, 9)
    lines = lines_of(
        spark,
        [
            (None, day(1), "YES", 10),
            (date(2019, 12, 31), day(2), "YES - LINKED", 20),
            (date(2020, 1, 1), day(3), "YES", 30),
            (cutoff, day(4), "YES", 40),
            (cutoff - timedelta(days=1), day(5), "YES", 50),
            (day(6), day(6), "NO", 60),
            (day(7), day(7), None, 70),
            (None, None, "YES", 80),
        ],
    )
    cleaned = cleaning.clean_line_list(lines, LineList(), AS_OF)
    assert {row["age"]: row["event_date"] for row in cleaned.collect()} == {
        10: day(1),
        20: day(2),
        30: date(2020, 1, 1),
        50: cutoff - timedelta(days=1),
    }


def test_band_edges(spark):
    ages = [0, 19, 20, 39, 40, 59, 60, 79, 80, 114, 115, -1, None]
    cases = spark.createDataFrame([(D, age) for age in ages], "event_date date, age int")
    row = band_daily_counts(cases, AGE_BANDS).collect()[0]
    assert [row[band.sum] for band in AGE_BANDS] == [2, 2, 2, 2, 2]


def test_date_without_a_banded_age_keeps_its_row(spark):
    cases = spark.createDataFrame([(D, None), (D, 120)], "event_date date, age int")
    row = band_daily_counts(cases, AGE_BANDS).collect()[0]
    assert row["event_date"] == D
    assert [row[band.sum] for band in AGE_BANDS] == [None] * 5


def test_banded_and_other_cases_add_up(spark):
    cases = spark.range(1000).select(
        F.lit(D).alias("event_date"), (F.col("id") % 150 - 5).cast("int").alias("age")
    )
    row = band_daily_counts(cases, AGE_BANDS).collect()[0]
    outside = cases.filter("age < 0 or age > 114").count()
    assert sum(row[band.sum] for band in AGE_BANDS) + outside == 1000


def test_series_date_outside_the_spine_keeps_its_date(spark):
    totals = spark.createDataFrame([(day(1), 1, 1), (day(3), 2, 3)], "Date date, s bigint, c bigint")
    spine = spark.createDataFrame([(day(0),), (day(1),), (day(2),)], "Date date")
    complete = series.complete_dates(totals, spine)
    filled = series.forward_fill(complete, "Date", ["c"]).na.fill(0)
    assert values(filled, "Date", "s", "c") == [
        (day(0), 0, 0),
        (day(1), 1, 1),
        (day(2), 0, 1),
        (day(3), 2, 3),
    ]


def test_zero_counts_as_missing_unless_told_otherwise(spark):
    rows = spark.createDataFrame([(day(n), v) for n, v in enumerate((2.0, 0.0, 1.0, None))], "d date, v double")
    fill = lambda flag: [
        r["v"] for r in series.forward_fill(rows, "d", ["v"], zero_is_missing=flag).orderBy("d").collect()
    ]
    assert fill(True) == [2.0, 2.0, 1.0, 1.0]
    assert fill(False) == [2.0, 0.0, 1.0, 1.0]


def test_back_fill(spark):
    rows = spark.createDataFrame([(0, None), (1, 5), (2, None), (3, 7), (4, None)], "d int, v int")
    filled = series.back_fill(rows, "d", ["v"]).orderBy("d").collect()
    assert [row["v"] for row in filled] == [5, 5, 7, 7, None]


def test_average_counts_rows_and_not_days(spark):
    rows = spark.createDataFrame([(day(n * n), 7 * (n + 1)) for n in range(9)], "Date date, c bigint")
    averaged = series.row_average(rows, "Date", {"c": "a"}).orderBy("Date").collect()
    assert [row["a"] for row in averaged] == [0.0] * 7 + [7.0, 7.0]


def test_whole_table_by_hand(spark):
    rows = [(day(n), day(n), "YES", 30) for n in range(9)]
    rows += [(day(8), day(8), "YES", 30)] * 7
    rows += [(day(20), day(21), "NO", 30)]
    result = trend.band_trend(lines_of(spark, rows), AS_OF, bands=ONE_BAND).orderBy("Date").collect()
    assert [row["Date"] for row in result] == [*map(day, range(9)), day(20)]
    assert [row["age_group_all_sum"] for row in result] == [1] * 8 + [8, 0]
    assert [row["age_group_all_cumulative"] for row in result] == [*range(1, 9), 16, 16]
    # Rows 8, 9 and 10 look seven rows back to totals of 1, 2 and 3.
    assert [row["age_group_all_avg7day"] for row in result][7:] == [1.0, 2.0, 1.9]
    # The change counts reported dates; the last date of an event has no report.
    assert [row["diff_age_group_all_avg7day"] for row in result][7:] == [0.0, 0.0, None]


def test_dates_from_the_cutoff_on_have_no_change(spark):
    late = date(2021, 3, 20)
    rows = [(D, D, "YES", 5), (late, late, "YES", 5), (None, late, "YES", 5)]
    result = trend.band_trend(lines_of(spark, rows), AS_OF).orderBy("Date").collect()
    assert [row["Date"] for row in result] == [D, late]
    assert [row["age_group_0_19_cumulative"] for row in result] == [1, 1]
    assert [row["diff_age_group_0_19_avg7day"] for row in result] == [0.0, None]


def line_list_with_everything(spark):
    """Gaps, fallbacks onto new dates, dates without reports, every kind of outcome."""
    n = F.col("id")
    return spark.range(4000).select(
        F.when(n % 7 != 0, F.date_add(F.lit(date(2019, 12, 20)), (n * 13 % 523).cast("int"))).alias(
            "event_date"
        ),
        F.date_add(F.lit(date(2020, 1, 3)), (n * 29 % 467).cast("int")).alias(
            "reported_date"
        ),
        F.element_at(
            F.array(F.lit("YES"), F.lit("NO"), F.lit("YES - LINKED"), F.lit(None)),
            (n % 4 + 1).cast("int"),
        ).alias("outcome"),
        (n * 31 % 125 - 4).cast("int").alias("age"),
        (n % 3).alias("segment"),
    )


@pytest.mark.parametrize("zero_is_missing", [True, False])
def test_one_pass_equals_the_steps(spark, zero_is_missing):
    lines = line_list_with_everything(spark).drop("segment")
    whole = trend.band_trend(lines, AS_OF, zero_is_missing=zero_is_missing)
    steps = stepwise(lines, AGE_BANDS, AS_OF, zero_is_missing)
    assert whole.count() > 400
    assert values(whole, *whole.columns) == values(steps, *whole.columns)


def test_segments_are_tables_of_their_own(spark):
    lines = line_list_with_everything(spark)
    by_segment = trend.band_trend(lines, AS_OF, partition_by=["segment"])
    for segment in range(3):
        alone = trend.band_trend(lines.filter(F.col("segment") == segment), AS_OF)
        mine = by_segment.filter(F.col("segment") == segment)
        assert values(mine, *alone.columns) == values(alone)


def test_times_of_day_do_not_matter(spark):
    """The calendar has whole days, whatever the line list holds."""
    lines = line_list_with_everything(spark).drop("segment")
    hours = F.make_interval(hours=F.col("age") % 24)
    timed = lines.withColumns(
        {c: F.col(c).cast("timestamp") + hours for c in ("event_date", "reported_date")}
    )
    timed = timed.withColumn("age", F.col("age") % 24).filter("age >= 0")
    plain = lines.withColumn("age", F.col("age") % 24).filter("age >= 0")
    assert values(trend.band_trend(timed, AS_OF)) == values(trend.band_trend(plain, AS_OF))


def test_running_total_ends_at_the_total(spark):
    lines = line_list_with_everything(spark)
    result = trend.band_trend(lines, AS_OF).orderBy("Date").collect()
    for band in AGE_BANDS:
        assert result[-1][band.cumulative] == sum(row[band.sum] for row in result)


def test_line_list_is_read_once_and_never_gathered_unaggregated(spark, sf_dir):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["band_trend"](spark, sf_dir))
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("orders.parquet") == 1
    assert "SortMergeJoin FullOuter" not in plan
    before_gathering = plan[plan.index("Exchange SinglePartition") :].splitlines()[1]
    assert "HashAggregate(keys=[Date" in before_gathering
