"""Labels, names and lookups."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import values
from trendline.functions import (
    compact_date,
    join_range_label,
    parse_day,
    safe_column_names,
    safe_names,
    strip_week_token,
    week_label_day,
)
from trendline.functions.fixed_values import REGION_SHORT_NAMES
from trendline.operators import cleaning, combine
from trendline.plans import label_repair


def applied(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    rows = df.select("n", function(F.col("t")).alias("r")).orderBy("n").collect()
    return [row["r"] for row in rows]


def test_week_labels(spark):
    cases = {
        "2020 Week20 May23 2021": date(2021, 5, 23),
        "2020 Week20 May23": date(2020, 5, 23),
        "2020 Week20 may23": date(2020, 5, 23),
        "2020-Week20 May23 2021": date(2021, 5, 23),
        "2020 20 May23": None,
        "2020Week20May23": None,
        "2020 Week20 May2 2021": None,
        "2020 Week 20 May23 2021": None,
        "Week20": None,
        "": None,
        None: None,
    }
    assert applied(spark, week_label_day, list(cases)) == list(cases.values())


def test_compact_dates(spark):
    cases = {
        "2020 Jan02 2021": "2021jan02",
        "2020Jan022021": "2021jan02",
        "2020 Jan02 2021 and more": "2021jan02",
        "2020 Week20 May23 2021": "2020 Week20 May23 2021",
        "2021may23": "2021may23",
        None: None,
    }
    assert applied(spark, compact_date, list(cases)) == list(cases.values())


def test_week_tokens(spark):
    cases = {
        "2020 Week20 May23": "2020may23",
        "week01 WEEK02 x": "x",
        "Week2": "week2",
        None: None,
    }
    assert applied(spark, strip_week_token, list(cases)) == list(cases.values())


def test_range_labels(spark):
    cases = {
        "12to17": "12-17",
        "12 to 17": "12 - 17",
        "80+": "80+",
        "Total": "Total",
        "1to2to3": "1-2",
        None: None,
    }
    assert applied(spark, join_range_label, list(cases)) == list(cases.values())


def test_repeated_labels_do_not_multiply(spark):
    at = datetime(2023, 1, 1, 6)
    rows = [(n, label, at, at) for n, label in enumerate(["12to17", "12to17", "80+", None])]
    sheet = spark.createDataFrame(
        rows, "n int, age_group_new string, `current_date:` timestamp, `yesterday_date:` timestamp"
    )
    repaired = label_repair.repair_age_sheet(sheet, "n")
    assert values(repaired, "id", "age_group", "`current_date:`") == [
        (1, "12-17", date(2023, 1, 1)),
        (2, "12-17", date(2023, 1, 1)),
        (3, "80+", date(2023, 1, 1)),
        (4, None, date(2023, 1, 1)),
    ]


def test_dirty_dates_become_null(spark):
    parsed = applied(spark, lambda c: parse_day(c, "yyyy-MM-dd"), ["2021-02-03", "soon", None])
    assert parsed == [date(2021, 2, 3), None, None]


def test_safe_names():
    assert safe_names(["Cumulative doses", "7-day avg", "people_w/ X", "a,b;c{}()\n\t=", "d:"]) == [
        "cumulative_doses",
        "7-day_avg",
        "people_w/_x",
        "a_b_c_______",
        "d:",
    ]
    assert safe_names(["A", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_safe_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Spring/Fall Booster` int, `spring/fall_booster` int")
    assert safe_column_names(df).columns == ["spring/fall_booster", "spring/fall_booster_2"]


def test_region_names_by_lookup(spark):
    sheet = spark.createDataFrame(
        [("North Unit", 1), ("North Unit", 2), ("Unheard of", 3)], "public_health_unit string, n int"
    )
    renamed = label_repair.rename_regions(sheet, {"North Unit": "North", "South Unit": "South"})
    assert values(renamed, "n", "new_PHUnames") == [(1, "North"), (2, "North")]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_region_names_by_position(spark, partitions):
    sheet = spark.range(len(REGION_SHORT_NAMES)).select(
        F.format_string("Unit %02d", "id").alias("unit")
    )
    renamed = label_repair.rename_regions_in_order(sheet.repartition(partitions), "unit")
    assert values(renamed, "unit", "new_PHUnames") == [
        (f"Unit {n:02d}", name) for n, name in enumerate(REGION_SHORT_NAMES)
    ]


def test_union_by_name_fills_missing_columns(spark):
    left = spark.createDataFrame([(1, "a")], "k int, n string")
    right = spark.createDataFrame([("b", 2.5)], "n string, x double")
    assert values(combine.union_by_name(left, right), "k", "n", "x") == [
        (1, "a", None),
        (None, "b", 2.5),
    ]


def test_union_by_position_keeps_the_left_names(spark):
    left = spark.createDataFrame([(1, "a")], "k int, n string")
    right = spark.createDataFrame([(2, "b")], "other int, names string")
    union = combine.union_by_position(left, right)
    assert union.columns == ["k", "n"]
    assert values(union) == [(1, "a"), (2, "b")]


def test_footer_goes(spark):
    sheet = spark.createDataFrame([(5, "foot"), (1, "a"), (3, "b")], "row_idx int, t string")
    assert values(cleaning.drop_footer(sheet.repartition(3), "row_idx"), "t") == [("a",), ("b",)]


def test_only_numbers_are_filled(spark):
    df = spark.createDataFrame([(None, None, None)], "n int, t string, d date")
    assert cleaning.fill_numeric_nulls(df).collect() == [(0, None, None)]


def test_columns_in_byte_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, Date int, `a.x` int")
    assert cleaning.sorted_columns(df).columns == ["Date", "a.x", "b"]


def test_dates_before_a_limit(spark):
    days = spark.createDataFrame([(date(2021, 1, d),) for d in (1, 2, 3)] + [(None,)], "d date")
    assert values(cleaning.before(days, "d", date(2021, 1, 3))) == [
        (date(2021, 1, 1),),
        (date(2021, 1, 2),),
    ]
