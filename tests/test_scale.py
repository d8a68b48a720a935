"""Skewed inputs: a third of the rows under one key."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracles
from conftest import plan_of, values
from trendline.plans import chat_corpus


@contextlib.contextmanager
def settings(spark, **changes):
    names = {key.replace("__", "."): value for key, value in changes.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.fixture(scope="module")
def skewed_dir(spark, sf_dir, tmp_path_factory):
    """Tables where one order holds a third of the items and one customer a third of the orders."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in check_oracles.TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            hot = F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice") % 3 == 0
            df = df.withColumn("l_orderkey", F.when(hot, F.lit(7)).otherwise(F.col("l_orderkey")))
        if name == "orders":
            hot = F.xxhash64("o_orderkey") % 3 == 0
            df = df.withColumn("o_custkey", F.when(hot, F.lit(5)).otherwise(F.col("o_custkey")))
        if name == "conversations":
            lone = df.filter("conv_id = 3").agg(F.max("turn") + 1).collect()[0][0]
            more = spark.range(df.count() // 2).select(
                F.lit(3).cast("bigint").alias("conv_id"),
                (F.col("id") + F.lit(lone)).alias("turn"),
                F.lit("user").alias("role"),
                F.format_string("more of the same, turn %d", "id").alias("text"),
            )
            df = df.unionByName(more)
        df.repartition(12).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in check_oracles.TABLES:
        path = f"{folder}/{name}.parquet/*.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


SKEWED = (
    "band_trend",
    "band_trend_by_segment",
    "kpi_by_segment",
    "fill_numeric_nulls",
    "sft_text",
    "sft_truncate",
    "sft_length_batches",
)


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_tables_give_right_results(name, spark, skewed_dir):
    connection = connect(skewed_dir)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        result = entry.queries()[name](spark, skewed_dir)
        oracle = connection.execute(entry.oracle_sql()[name])
        assert check_oracles.compare(result, oracle) is None


def test_hot_order_is_split(spark, skewed_dir):
    changes = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4KB",
        "spark__sql__files__maxPartitionBytes": "16KB",
    }
    with settings(spark, **changes):
        result = entry.queries()["band_trend"](spark, skewed_dir)
        rows = result.collect()
        plan = plan_of(result)
    assert "skew=true" in plan
    assert len(rows) == len(entry.queries()["band_trend"](spark, skewed_dir).collect())


@pytest.mark.parametrize("most", [40, 1100])
def test_endless_conversation_stays_bounded(spark, most):
    turns = spark.range(150_000, numPartitions=20).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("some words here").alias("text"),
    )
    texts = chat_corpus.conversation_texts(turns)
    assert texts.agg(F.max("n_turns"), F.sum("n_turns")).collect() == [(100_000, 150_000)]
    cut = chat_corpus.truncated_texts(turns, most)
    assert values(cut.filter("conv_id = 0"), "n_tokens") == [(most,)]
    # What reaches the last step of the long conversation: at most so many rows of each salted part.
    plan = cut._jdf.queryExecution().optimizedPlan()
    limits = [line for line in plan.toString().splitlines() if f"<= {most})" in line]
    assert len(limits) == 2
