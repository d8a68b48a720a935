"""Prefix sums, row numbers and positional joins."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of, values
from trendline.operators import ordered


def scattered(spark, rows=5000):
    """Unique keys without a pattern; a third of the rows shares one value of ``a``."""
    return spark.range(0, rows, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.xxhash64("id") % 1000).alias("a"),
        F.xxhash64("id", F.lit(1)).alias("b"),
        (F.col("id") % 17).alias("v"),
    )


@pytest.mark.parametrize("ranges", [None, 1, 2, 50, 300])
def test_running_sum_equals_one_window(spark, ranges):
    df = scattered(spark)
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("s", F.sum("v").over(whole))
    result = ordered.running_sum(df, "b", F.col("v"), "s", ranges)
    assert values(result, "b", "s") == values(expected, "b", "s")


def test_row_index_over_a_hot_first_column(spark):
    df = scattered(spark)
    expected = df.withColumn("id", F.row_number().over(Window.orderBy("a", "b")))
    result = ordered.row_index(df, ["a", "b"], ranges=40)
    assert values(result, "a", "b", "id") == values(expected, "a", "b", "id")


def test_hot_first_column_is_cut_apart(spark):
    cut, ranges = ordered.in_ranges(scattered(spark), ["a", "b"], ranges=20)
    sizes = [row["count"] for row in cut.groupBy(ordered.RANGE).count().collect()]
    assert ranges == 20 and len(sizes) >= 18
    assert max(sizes) < 3 * 5000 / 20


def gappy(spark, rows=4000):
    """Long stretches of missing values, zeros, and a third of the rows with one value of ``a``."""
    value = F.when(F.col("id") % 701 == 5, F.col("id") + 1).when(F.col("id") % 3 == 0, F.lit(0))
    return scattered(spark, rows).withColumn("id", F.col("b") % 100_003).select(
        "a", "b", value.alias("x"), F.when(F.col("v") > 12, F.col("v")).alias("y")
    )


@pytest.mark.parametrize("ranges", [2, 7, 60])
@pytest.mark.parametrize("fan", [1000, 3])
def test_fills_equal_one_window(spark, monkeypatch, ranges, fan):
    monkeypatch.setattr(ordered, "FAN", fan)
    df = gappy(spark)
    whole = Window.orderBy("a", "b")
    past = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for zero in (True, False):
        known = {name: F.nullif(name, F.lit(0)) if zero else F.col(name) for name in "xy"}
        expected = df.withColumns({n: F.last(known[n], ignorenulls=True).over(past) for n in "xy"})
        result = ordered.forward_fill(df, ["a", "b"], ["x", "y"], zero, ranges)
        assert values(result) == values(expected)
        expected = df.withColumns({n: F.first(known[n], ignorenulls=True).over(future) for n in "xy"})
        result = ordered.back_fill(df, ["a", "b"], ["x", "y"], zero, ranges)
        assert values(result) == values(expected)


def test_no_row_of_a_back_fill_looks_through_all_later_ones(spark):
    plan = plan_of(ordered.back_fill(gappy(spark), ["a", "b"], ["x", "y"], True, 7))
    assert "Window" in plan and "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize(("rows", "block_rows"), [(7, 7), (7, 100), (1, 1), (6, 10_000)])
def test_lags_equal_one_window(spark, rows, block_rows):
    df = gappy(spark, 500)
    whole = Window.orderBy("a", "b")
    lag = F.lag("y", rows).over(whole)
    expected = df.withColumns({"before": lag, "change": F.coalesce(F.col("y") - lag, F.lit(0))})
    found = ordered.lag_rows(df, ["a", "b"], {"y": "before"}, rows, 9, block_rows)
    assert values(found) == values(expected.drop("change"))
    found = ordered.lagged_change(df, ["a", "b"], {"y": "change"}, rows, 9, block_rows)
    assert values(found) == values(expected.drop("before"))
    with pytest.raises(ValueError, match="rows back"):
        ordered.lag_rows(df, "b", {"y": "z"}, 5, block_rows=4)


def test_only_missing_values_and_no_rows(spark):
    df = spark.range(50).select("id", F.lit(None).cast("int").alias("x"))
    for fill in (ordered.forward_fill, ordered.back_fill):
        assert fill(df, "id", ["x"], ranges=5).filter("x is not null").isEmpty()
        assert fill(df.filter("id < 0"), "id", ["x"]).isEmpty()
    assert ordered.lag_rows(df.filter("id < 0"), "id", {"x": "y"}, 3).isEmpty()


@pytest.mark.parametrize(
    "make",
    [
        lambda n: f"key-{n:05d}",
        lambda n: date(2020, 1, 1) + timedelta(days=n),
        lambda n: n / 7,
        lambda n: None if n == 0 else n,
    ],
    ids=["text", "date", "double", "null first"],
)
def test_keys_of_any_type(spark, make):
    rows = [(make(n), n) for n in range(300)]
    df = spark.createDataFrame(rows[::-1], ["k", "n"]).repartition(5)
    result = ordered.row_index(df, "k", ranges=9)
    assert values(result, "n", "id") == sorted(((n, n + 1) for n in range(300)), key=repr)


def test_running_sum_of_nulls(spark):
    df = spark.createDataFrame([(n, None if n < 30 else 1) for n in range(60)], "k int, v int")
    result = ordered.running_sum(df, "k", F.col("v"), "s", ranges=6).orderBy("k").collect()
    assert [row["s"] for row in result] == [None] * 30 + list(range(1, 31))


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert ordered.running_sum(df, "k", F.col("v"), "s").collect() == []


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_zip_is_the_same_under_any_partitioning(spark, partitions):
    left = spark.range(50).select((F.col("id") * 10).alias("a")).repartition(partitions)
    right = spark.range(35).select((F.col("id") * -3).alias("b")).repartition(partitions)
    result = ordered.zip_by_position(left, right, "a", "b")
    expected = [(n + 1, n * 10, (34 - n) * -3) for n in range(35)]
    assert values(result, "id", "a", "b") == sorted(expected, key=repr)


@pytest.mark.parametrize(
    "work",
    [
        lambda df, n: ordered.row_index(df, "k", ranges=n),
        lambda df, n: ordered.running_sum(df, "k", F.col("v"), "s", n),
        lambda df, n: ordered.forward_fill(df, "k", ["v"], ranges=n),
        lambda df, n: ordered.lag_rows(df, "k", {"v": "w"}, 7, n),
    ],
    ids=["row_index", "running_sum", "forward_fill", "lag_rows"],
)
def test_plans_gather_no_rows_and_do_not_grow_with_the_ranges(spark, work):
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k"), (F.col("id") % 5).alias("v"))
    plans = [plan_of(work(df, ranges)) for ranges in (20, 40)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert "SinglePartition" not in plans[0] and "[_group" in plans[0]


@pytest.mark.parametrize("fan", [2, 4, 1000])
def test_totals_are_summed_in_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(ordered, "FAN", fan)
    df = scattered(spark, 3000)
    expected = df.withColumn("id", F.row_number().over(Window.orderBy("b")))
    assert values(ordered.row_index(df, "b", ranges=30), "b", "id") == values(expected, "b", "id")


def test_the_frame_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000).mapInArrow(watched, "id bigint")
    result = ordered.row_index(df.withColumn("k", -F.col("id")), "k", out="place")
    assert result.agg(F.max("place")).collect() == [(5000,)]
    assert seen.value == 5000
