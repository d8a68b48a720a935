"""Whole jobs from files to a table."""

from __future__ import annotations

import random
import re
import zipfile
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from conftest import values
from trendline.catalog import roundtrip
from trendline.functions import compact_date, strip_week_token, week_label_day
from trendline.functions.fixed_values import REGION_SHORT_NAMES
from trendline.plans import band_trend, daily_tracker, label_repair
from trendline.sources import tables, text_files, workbooks


def test_archive_to_trend_table(spark, tmp_path):
    lines = ["event_date,reported_date,outcome,age"]
    for n in range(40):
        day = date(2020, 6, 1) + timedelta(days=n)
        lines += [f"{day},{day},YES,{age}" for age in (5, 25, 45, 65, 85)]
        lines.append(f",{day},YES,85")
        lines.append(f"{day},{day},NO,85")
    with zipfile.ZipFile(tmp_path / "lines.zip", "w") as archive:
        archive.writestr("lines.csv", "\n".join(lines))
    cases = text_files.read_zipped_csv(
        spark, str(tmp_path), "event_date date, reported_date date, outcome string, age int"
    )
    trend = band_trend.band_trend(cases, date(2020, 8, 5))
    stored = tables.replace_table(trend, "trendline_test_trend", str(tmp_path / "trend"))
    last = stored.orderBy(F.desc("Date")).first()
    assert stored.count() == 40
    assert last["age_group_0_19_cumulative"] == 40
    assert last["age_group_80_and_over_cumulative"] == 80
    assert last["age_group_80_and_over_avg7day"] == 2.0
    assert last["diff_age_group_80_and_over_avg7day"] == 0.0


def test_workbook_to_tracker_table(spark, tmp_path):
    start = datetime(2022, 3, 1)
    rows = [(start + timedelta(days=n), 100 + n, 50.0 + n, 10 * n, 5 * n, n) for n in range(12)]
    rows.append((None, 9999, 9999.0, 9999, 9999, 9999))
    sheet = spark.createDataFrame(
        rows,
        "Date timestamp, `Daily dose count total` bigint, `Doses administered 7-day avg` double,"
        " `People w/ at least one dose` bigint, `People fully vaccinated` bigint,"
        " `People w/ fall booster` bigint",
    )
    folder = str(tmp_path / "book")
    roundtrip.write_workbooks(sheet.coalesce(1), folder, "Results(2)")
    read = workbooks.read_sheet(spark, folder, "Results(2)", sheet.schema).drop("path")
    tracker = daily_tracker.tracker_from_sheet(read)
    attached = daily_tracker.attach_kpis(tracker)
    stored = tables.replace_table(attached, "trendline_test_tracker", str(tmp_path / "t"))
    assert stored.count() == 12
    latest = stored.filter("cumulative_doses is not null").collect()
    assert len(latest) == 1
    assert latest[0]["Date"] == date(2022, 3, 12)
    assert latest[0]["cumulative_doses"] == sum(range(100, 112))
    assert latest[0]["7day_rolling_min1dose"] == 70
    assert latest[0]["spring/fall_booster_7dayroll"] == 7


def test_every_tracker_workbook_loses_its_own_footer(spark, tmp_path):
    folder = str(tmp_path / "books")
    for number, days in enumerate((3, 5)):
        rows = [(datetime(2022, 3, 1 + day), day) for day in range(days)] + [(None, 999)]
        sheet = spark.createDataFrame(rows, "Date timestamp, doses bigint")
        roundtrip.write_workbooks(sheet.coalesce(1), f"{folder}/{number}", "Results(2)")
    read = workbooks.read_sheet(spark, f"{folder}/*", "Results(2)", sheet.schema)
    tracker = daily_tracker.tracker_from_sheet(read, workbook="path")
    assert sorted(row["doses"] for row in tracker.collect()) == [0, 0, 1, 1, 2, 2, 3, 4]


def test_region_workbook_gets_its_short_names(spark, tmp_path):
    units = spark.createDataFrame(
        [(f"Unit of {name}", n) for n, name in enumerate(REGION_SHORT_NAMES)],
        "public_health_unit string, doses int",
    )
    folder = str(tmp_path / "book")
    roundtrip.write_workbooks(units.coalesce(1), folder, "Results")
    sheet = workbooks.read_sheet(spark, folder, "Results", units.schema)
    renamed = label_repair.rename_regions_in_order(sheet, "row_idx")
    assert values(renamed, "public_health_unit", "new_PHUnames") == values(
        units.select("public_health_unit", F.substring("public_health_unit", 9, 99))
    )


def random_labels(count):
    """Labels near the shapes that the repairs look for."""
    draw = random.Random(11)
    pieces = ["2020", "2021", "Week20", "Week", "week07", "May23", "Jan02", "may5", "Feb30"]
    pieces += ["20", "x", "2020 Jan02 2021", "1999"]
    return [
        "".join(draw.choice(pieces) + draw.choice([" ", " ", "", "-"]) for _ in range(draw.randint(1, 5)))
        for _ in range(count)
    ]


def day_of_label(label):
    """The day a week label means, worked out piece by piece."""
    if "Week" not in label or " " not in label:
        return None
    pieces = re.split("[ -]", label.replace("Week", ""))
    if len(pieces) < 3:
        return None
    year = pieces[3] if len(pieces) > 3 else pieces[0]
    if not re.fullmatch("[0-9]{4}", year) or not re.fullmatch("[A-Za-z]{3}[0-9]{2}", pieces[2]):
        return None
    try:
        return datetime.strptime(f"{year} {pieces[2]}", "%Y %b%d").date()
    except ValueError:
        return None


def test_random_labels_against_plain_python(spark):
    labels = random_labels(3000)
    df = spark.createDataFrame(list(enumerate(labels)), "n int, t string").select(
        "n", *[f(F.col("t")) for f in (week_label_day, compact_date, strip_week_token)]
    )
    days = 0
    for (n, day, compact, stripped), label in zip(df.orderBy("n").collect(), labels, strict=True):
        squeezed = label.lower().replace(" ", "")
        shape = re.match("[0-9]{4}([a-z]{3})([0-9]{2})([0-9]{4})", squeezed)
        assert compact == (shape[3] + shape[1] + shape[2] if shape else label), label
        assert stripped == re.sub("week[0-9][0-9]", "", squeezed), label
        assert day == day_of_label(label), label
        days += day is not None
    assert days > 20
