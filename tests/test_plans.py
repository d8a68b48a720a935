"""Properties that the plan of every registered query has."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from conftest import plan_of, values
from trendline.catalog.queries import QUERIES
from trendline.plans import chat_corpus

READERS = ("read_zipped_csv", "read_workbooks")
# The layout of spans and the decoding of character references are small helpers in Python.
MARKUP = ("page_grid", "page_asset_list")


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    """For each query the plan of its result and of everything that it stored on the way."""
    found, stored = {}, []
    plain = DataFrameWriter.parquet

    def watched(writer, *args, **options):
        stored.append(plan_of(writer._df))
        return plain(writer, *args, **options)

    DataFrameWriter.parquet = watched
    try:
        for name, query in QUERIES.items():
            stored.clear()
            found[name] = "\n".join([plan_of(query(spark, sf_dir)), *stored])
    finally:
        DataFrameWriter.parquet = plain
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_only_aggregates_are_gathered(name, plans):
    lines = plans[name].splitlines()
    for place, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[place + 1 :]
            # What is gathered is an aggregate, or the stored calendar, which is one already.
            scan = next((below for below in below if "FileScan" in below), "")
            assert "HashAggregate(" in below[0] or "/trendline/calendar-" in scan, below[0]


@pytest.mark.parametrize("name", QUERIES)
def test_no_products_of_rows(name, plans):
    assert "CartesianProduct" not in plans[name]
    assert "BroadcastNestedLoopJoin" not in plans[name]


@pytest.mark.parametrize("name", QUERIES)
def test_python_only_where_files_are_decoded(name, plans):
    python = ("MapInPandas", "MapInArrow", "BatchEvalPython", "ArrowEvalPython", "zipped_csv", "BatchScan workbook")
    assert any(node in plans[name] for node in python) == name.startswith(READERS + MARKUP)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("kpi_row", "o_orderstatus,o_orderdate"),
        ("cumulative_two_phase", "o_orderkey,o_totalprice"),
        ("date_spine", "l_orderkey,l_linenumber,l_shipdate"),
        ("page_rows", "page_id,html"),
        ("rename_lookup", "c_custkey,c_mktsegment"),
    ],
)
def test_scans_read_only_what_is_needed(name, columns, plans):
    scanned = {
        tuple(column.split("#")[0] for column in line.split("[", 1)[1].split("]")[0].split(","))
        for line in plans[name].splitlines()
        if "FileScan" in line
    }
    assert tuple(columns.split(",")) in scanned


def test_filters_reach_the_scan(plans):
    assert "EqualTo(lang,en)" in plans["corpus_split"]
    assert "StringContains(l_returnflag,R)" in plans["linelist_clean"]
    assert "LessThan(o_orderkey,ScalarSubquery" in plans["drop_footer"]
    assert "PartitionFilters: [isnotnull(lang" in plans["corpus_split_stored"]


def test_a_stored_split_is_read_alone(spark, tmp_path):
    folder = str(tmp_path / "splits")
    rows = [(n, "train" if n % 3 else None if n == 0 else "test") for n in range(30)]
    chat_corpus.store_splits(spark.createDataFrame(rows, "id int, split string"), "split", folder)
    left = chat_corpus.load_split(spark.read.parquet(folder), "split", "test")
    assert values(left, "id") == sorted(((n,) for n in range(3, 30, 3)), key=repr)
    assert all("split=test" in row.name for row in left.select(F.input_file_name().alias("name")).collect())
    assert "PartitionFilters: [isnotnull(split" in plan_of(left)
