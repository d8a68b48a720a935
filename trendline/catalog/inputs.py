"""The jobs' inputs, derived from the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendline.operators import series
from trendline.operators.bands import Band
from trendline.operators.cleaning import LineList
from trendline.plans import daily_tracker as tracker_job
from trendline.sources.tables import read_table_files

AS_OF = date(2001, 7, 4)
FACTS = LineList(outcome_text="R", earliest_event=date(1996, 1, 1))
BANDS = (
    Band("0_9", 0, 9, 6),
    Band("10_19", 10, 19, 6),
    Band("20_29", 20, 29, 6),
    Band("30_39", 30, 39, 7),
    Band("40_50", 40, 50, 7),
)

# Some market segments and their short names; the last segment has none.
SEGMENT_NAMES = {
    "AUTOMOBILE": "Auto",
    "BUILDING": "Build",
    "FURNITURE": "Furn",
    "MACHINERY": "Mach",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table_files(spark, sf_dir, name)


def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases: shipped is the event, ordered is the report."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("event_date"),
        F.col("l_returnflag").alias("outcome"),
        F.col("l_quantity").cast("int").alias("age"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("reported_date"),
        F.col("o_orderpriority").alias("segment"),
    )
    return items.join(orders, "o_orderkey").drop("o_orderkey")


def _tracker(orders: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Orders per day as the daily metric, running counts per status as cumulative ones."""
    date_name = tracker_job.DATE
    status = F.col("o_orderstatus")
    daily = orders.groupBy(*partition_by, F.to_date("o_orderdate").alias(date_name)).agg(
        F.count("*").alias(tracker_job.DOSES),
        F.count_if(status == "F").alias("_f"),
        F.count_if(status == "O").alias("_o"),
        F.count_if(status == "P").alias("_p"),
    )
    last_seven = series.in_order(date_name, partition_by).rowsBetween(-6, 0)
    averaged = daily.withColumn(
        tracker_job.DOSES_AVERAGE, F.avg(tracker_job.DOSES).over(last_seven)
    )
    totals = {
        "_f": tracker_job.FIRST_DOSE,
        "_o": tracker_job.FULL_SERIES,
        "_p": tracker_job.BOOSTER,
    }
    return series.cumulative(averaged, date_name, totals, partition_by).drop(*totals)


def daily_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(table(spark, sf_dir, "orders"))


def tracker_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")
    )
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    return _tracker(orders.join(customers, "o_custkey"), ("nation",))


def patchy_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker without the values of every third day of the year."""
    return daily_tracker(spark, sf_dir).select(
        tracker_job.DATE,
        F.when(F.dayofyear(tracker_job.DATE) % 3 != 0, F.col(tracker_job.DOSES)).alias("doses"),
    )


def _week_token(day: Column) -> Column:
    return F.concat(F.lit("Week"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week labels of the order dates: even keys end with the year, some lack ``Week``."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    week = F.when(key % 5 == 0, F.lit("20")).otherwise(_week_token(day))
    tail = F.when(key % 2 == 0, F.date_format(day, " yyyy")).otherwise(F.lit(""))
    label = F.concat(
        F.date_format(day, "yyyy "), week, F.date_format(day, " MMMdd"), tail
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("week"))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the labels have the compact date shape, the others a week token."""
    day = F.to_date("o_orderdate")
    compact = F.date_format(day, "yyyy MMMdd yyyy")
    weekly = F.concat(F.date_format(day, "yyyy "), _week_token(day), F.date_format(day, " MMMdd"))
    label = F.when(F.col("o_orderkey") % 2 == 0, compact).otherwise(weekly)
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


def age_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their size as an age label and two time columns."""
    low = F.floor((F.col("p_size") - 1) / 10) * 10 + 1
    ranged = F.concat(low.cast("string"), F.lit("to"), (low + 9).cast("string"))
    label = F.when(F.col("p_size") >= 50, F.lit("50+")).otherwise(ranged)
    start = "timestamp_ntz '2023-01-01 06:30:00' + make_interval(0, 0, 0, p_size + {0})"
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        label.alias("age_group_new"),
        F.expr(start.format(1)).alias("current_date:"),
        F.expr(start.format(0)).alias("yesterday_date:"),
    )
