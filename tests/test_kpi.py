"""Headline figures on short daily series."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from trendline.operators import kpi
from trendline.plans import daily_tracker as tracker_job

SCHEMA = (
    "Date date, daily_dose_count_total bigint, `doses_administered_7-day_avg` double,"
    " `people_w/_at_least_one_dose` bigint, people_fully_vaccinated bigint,"
    " `people_w/_fall_booster` bigint"
)


def day(n):
    return date(2022, 1, 1) + timedelta(days=n)


def tracker(spark, doses, firsts=None):
    firsts = firsts or [10 * n for n in range(len(doses))]
    rows = [
        (day(n), dose, None if dose is None else dose / 2, first, first, first)
        for n, (dose, first) in enumerate(zip(doses, firsts, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def figures(spark, *args):
    rows = tracker_job.tracker_kpis(tracker(spark, *args)).collect()
    assert len(rows) == 1
    return rows[0]


def test_twelve_figures(spark):
    row = figures(spark, [50, 1, 2, 90, 4, 5, 6, 7, 8, 9, 10, 11])
    assert row["date"] == day(11)
    assert row["cumulative_doses"] == 203
    assert row["dailydose_count_total"] == 5 + 6 + 7 + 8 + 9 + 10 + 11
    assert row["daily_doses_lastdate"] == 11
    assert row["daily_dose_diff_"] == 0  # 90 lies nine rows back
    assert row["doses_administered_7dayavg"] == 5.5
    assert row["people_least1dose"] == 110
    assert row["7day_rolling_min1dose"] == 70
    assert row["spring/fall_booster_7dayroll"] == 70


def test_difference_is_to_the_highest_and_not_to_the_eighth(spark):
    row = figures(spark, [1, 2, 3, 4, 70, 6, 7, 8, 9])
    assert row["daily_dose_diff_"] == 9 - 70
    assert row["daily_dose_diff"] == 4.5 - 35


@pytest.mark.parametrize("length", [1, 6, 7, 8])
def test_short_series(spark, length):
    row = figures(spark, list(range(1, length + 1)))
    assert row["dailydose_count_total"] == sum(range(max(1, length - 6), length + 1))
    assert row["7day_rolling_min1dose"] == 10 * (length - 1)


def test_missing_latest_value(spark):
    row = figures(spark, [4, 5, None], [1, 2, None])
    assert row["daily_doses_lastdate"] == 0
    assert row["daily_dose_diff_"] == -5
    assert row["doses_administered_7dayavg"] == 0.0
    assert row["people_least1dose"] is None
    assert row["7day_rolling_min1dose"] is None
    assert kpi.latest_value(
        tracker(spark, [4, None]), "Date", tracker_job.DOSES, "v"
    ).collect() == [(None,)]


def test_missing_value_among_the_recent_ones(spark):
    row = figures(spark, [4, None, 6], [10, None, 30])
    assert row["dailydose_count_total"] == 10
    assert row["7day_rolling_min1dose"] == 20


def test_all_recent_values_missing(spark):
    assert figures(spark, [None, None])["dailydose_count_total"] == 0


def test_figures_land_on_the_latest_date(spark):
    attached = tracker_job.attach_kpis(tracker(spark, [1, 2, 3]))
    assert values(attached, "Date", "cumulative_doses") == [
        (day(0), None),
        (day(1), None),
        (day(2), 6),
    ]


def test_segments(spark):
    both = tracker(spark, [1, 2, 3]).withColumn("s", F.lit("a")).unionByName(
        tracker(spark, [10, 20]).withColumn("s", F.lit("b"))
    )
    rows = tracker_job.tracker_kpis(both, ("s",))
    assert values(rows, "s", "date", "cumulative_doses", "daily_doses_lastdate") == [
        ("a", day(2), 6, 3),
        ("b", day(1), 30, 20),
    ]


def test_latest_rows_are_a_top_k(spark):
    latest = kpi.latest_rows(tracker(spark, list(range(12))), "Date", 8, [tracker_job.DOSES])
    assert [row[0] for row in latest.collect()] == list(range(11, 3, -1))
    assert "TakeOrderedAndProject" in plan_of(latest)


def test_glued_rows(spark):
    one = spark.range(3).agg(F.sum("id").alias("s"), F.max("id").alias("m"))
    other = spark.range(4).agg(F.count("*").alias("n"))
    glued = kpi.glue_single_rows(one, other)
    assert glued.columns == ["s", "m", "n"]
    assert glued.collect() == [(3, 2, 4)]


def test_gluing_refuses_more_than_one_row(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        kpi.glue_single_rows(spark.range(2)).collect()


def test_figures_read_their_source_once(spark, sf_dir):
    import __spark_entry__ as entry

    assert plan_of(entry.queries()["kpi_row"](spark, sf_dir)).count("FileScan") == 1


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        kpi.kpi_rows(tracker(spark, [1]), "Date", [kpi.Kpi("x", tracker_job.DOSES, "median")])


def test_stored_series_gives_the_same_row(spark):
    rows = [(date(2021, 1, 1) + timedelta(days=n), None if n % 5 == 0 else n * 7 % 11) for n in range(40)]
    kpis = [
        kpi.Kpi("sum", "v", "total"),
        kpi.Kpi("week", "v", "recent_sum", rows=7),
        kpi.Kpi("now", "v", "latest"),
        kpi.Kpi("high", "v", "above_high", null_as_zero=True),
        kpi.Kpi("low", "v", "above_low"),
    ]
    for count in (0, 1, 6, 8, 12, 40):
        df = spark.createDataFrame(rows[:count], "day date, v bigint").repartition(3)
        one_pass, stored = kpi.kpi_rows(df, "day", kpis), kpi.stored_kpi_row(df, "day", kpis)
        assert stored.dtypes == one_pass.dtypes and stored.collect() == one_pass.collect()
    assert "Window" not in plan_of(stored)
