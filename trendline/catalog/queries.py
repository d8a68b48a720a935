"""One callable per registered query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendline.catalog import inputs, roundtrip
from trendline.catalog.inputs import AS_OF, BANDS, FACTS, table
from trendline.functions import (
    compact_date,
    safe_column_names,
    strip_week_token,
    weekly_cutoff,
)
from trendline.functions.sql_functions import register_sql_functions
from trendline.operators import cleaning, combine, kpi, ordered, series
from trendline.operators.bands import band_daily_counts
from trendline.plans import band_trend as trend
from trendline.plans import chat_corpus, label_repair, page_tables
from trendline.plans import daily_tracker as tracker_job
from trendline.sources import tables, text_files, workbook_source, workbooks, zipped_source
from trendline.workspace import shared_folder, written_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATE = tracker_job.DATE
DOSES = tracker_job.DOSES
NULL_TEXT = r"\N"


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# Trend per band


@query
def linelist_clean(spark, sf_dir):
    return cleaning.clean_line_list(inputs.line_list(spark, sf_dir), FACTS, AS_OF)


@query
def band_daily_counts_(spark, sf_dir):
    return _daily(spark, sf_dir)


def _daily(spark, sf_dir):
    return band_daily_counts(linelist_clean(spark, sf_dir), BANDS).withColumnRenamed(
        "event_date", trend.DATE
    )


@query
def band_cumulative(spark, sf_dir):
    return trend.band_cumulative(_daily(spark, sf_dir), BANDS, trend.DATE)


@query
def band_cumulative_by_segment(spark, sf_dir):
    lines = inputs.line_list(spark, sf_dir).filter(FACTS.is_case(AS_OF))
    cases = lines.select("segment", FACTS.case_date().alias(trend.DATE), "age")
    daily = band_daily_counts(cases, BANDS, trend.DATE, "age", ["segment"])
    return trend.band_cumulative(daily, BANDS, trend.DATE, ["segment"])


@query
def date_spine(spark, sf_dir):
    return cleaning.date_spine(inputs.line_list(spark, sf_dir), "event_date")


def _calendar(spark, sf_dir):
    lines = inputs.line_list(spark, sf_dir)
    return written_once(trend.calendar(lines, FACTS, BANDS, AS_OF), "calendar")


def _spine_filled(days):
    totals = trend.band_cumulative(trend.daily_counts(days, BANDS), BANDS, trend.DATE)
    return trend.spine_filled(totals, trend.event_dates(days), BANDS)


@query
def spine_ffill(spark, sf_dir):
    return _spine_filled(_calendar(spark, sf_dir))


@query
def band_avg7(spark, sf_dir):
    return trend.band_averages(_spine_filled(_calendar(spark, sf_dir)), BANDS)


@query
def reported_spine_diff(spark, sf_dir):
    days = _calendar(spark, sf_dir)
    averages = trend.band_averages(_spine_filled(days), BANDS)
    return trend.reported_changes(averages, trend.report_dates(days), BANDS, AS_OF)


@query
def band_trend(spark, sf_dir):
    return trend.band_trend(inputs.line_list(spark, sf_dir), AS_OF, FACTS, BANDS)


@query
def band_trend_by_segment(spark, sf_dir):
    return trend.band_trend(
        inputs.line_list(spark, sf_dir), AS_OF, FACTS, BANDS, partition_by=["segment"]
    )


@query
def weekly_cutoff_(spark, sf_dir):
    days = cleaning.date_spine(
        table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day", "day"
    )
    return days.withColumn("cutoff", weekly_cutoff(F.col("day")))


@query
def fill_numeric_nulls(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.max(F.to_date("o_orderdate")).alias("last_order")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return cleaning.fill_numeric_nulls(customers.join(counts, "c_custkey", "left"))


@query
def sorted_columns(spark, sf_dir):
    return cleaning.sorted_columns(table(spark, sf_dir, "customer"))


# Ordered work on keys of any size


@query
def cumulative_two_phase(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordered.running_sum(orders, "o_orderkey", price, "running_total").drop("o_totalprice")


@query
def row_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ordered.row_index(orders, ["o_orderdate", "o_orderkey"])


@query
def zip_by_position(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ordered.zip_by_position(customers, suppliers, "c_custkey", "s_suppkey")


def _items(spark, sf_dir):
    """Line items; a discount of 0 counts as missing. Only equal items share their order."""
    quantity = F.col("l_quantity").cast("bigint").alias("quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", quantity
    )


ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_discount", "quantity"]


@query
def ffill_ordered(spark, sf_dir):
    return ordered.forward_fill(_items(spark, sf_dir), ITEM_ORDER, ["l_discount"])


@query
def back_fill_ordered(spark, sf_dir):
    return ordered.back_fill(_items(spark, sf_dir), ITEM_ORDER, ["l_discount"], zero_is_missing=True)


@query
def lag_ordered(spark, sf_dir):
    return ordered.lagged_change(_items(spark, sf_dir), ITEM_ORDER, {"quantity": "change"}, rows=7)


# Headline figures


@query
def metric_total(spark, sf_dir):
    return kpi.metric_total(inputs.daily_tracker(spark, sf_dir), DOSES, "total")


@query
def last7_sum(spark, sf_dir):
    return kpi.latest_sum(inputs.daily_tracker(spark, sf_dir), DATE, DOSES, "last7")


@query
def latest_value(spark, sf_dir):
    return kpi.latest_value(inputs.daily_tracker(spark, sf_dir), DATE, DOSES, "latest")


@query
def top_k_latest(spark, sf_dir):
    return kpi.latest_rows(inputs.daily_tracker(spark, sf_dir), DATE, 8, [DOSES])


@query
def latest_minus_max8(spark, sf_dir):
    figure = kpi.Kpi("diff", DOSES, "above_high", null_as_zero=True)
    return kpi.kpi_rows(inputs.daily_tracker(spark, sf_dir), DATE, [figure])


@query
def latest_minus_min8(spark, sf_dir):
    figure = kpi.Kpi("diff", tracker_job.FIRST_DOSE, "above_low")
    return kpi.kpi_rows(inputs.daily_tracker(spark, sf_dir), DATE, [figure])


@query
def scalar_cross_join(spark, sf_dir):
    tracker = written_once(inputs.daily_tracker(spark, sf_dir), "tracker")
    return kpi.glue_single_rows(
        kpi.metric_total(tracker, DOSES, "total"),
        kpi.latest_sum(tracker, DATE, DOSES, "last7"),
        kpi.latest_value(tracker, DATE, DOSES, "latest"),
    )


@query
def kpi_row(spark, sf_dir):
    return tracker_job.tracker_kpis(inputs.daily_tracker(spark, sf_dir))


@query
def kpi_by_segment(spark, sf_dir):
    return tracker_job.tracker_kpis(inputs.tracker_by_nation(spark, sf_dir), ("nation",))


@query
def kpi_attach(spark, sf_dir):
    return tracker_job.attach_kpis(written_once(inputs.daily_tracker(spark, sf_dir), "tracker"))


# Labels and names


@query
def week_label_to_date(spark, sf_dir):
    return label_repair.repair_week_sheet(inputs.week_sheet(spark, sf_dir))


@query
def compact_date_fix(spark, sf_dir):
    labels = inputs.date_labels(spark, sf_dir)
    return labels.withColumn("fixed", compact_date(F.col("label")))


@query
def strip_week_token_(spark, sf_dir):
    labels = inputs.date_labels(spark, sf_dir)
    return labels.withColumn("stripped", strip_week_token(F.col("label")))


@query
def band_label(spark, sf_dir):
    return label_repair.repair_age_sheet(inputs.age_sheet(spark, sf_dir), "p_partkey")


@query
def rename_lookup(spark, sf_dir):
    sheet = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("public_health_unit")
    )
    return label_repair.rename_regions(sheet, inputs.SEGMENT_NAMES)


@query
def rename_by_position(spark, sf_dir):
    units = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("customers")
    )
    return label_repair.rename_regions_in_order(written_once(units, "units"), "c_nationkey")


@query
def timestamp_to_date(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query
def safe_column_names_(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    dirty = ["Supplier Key", "Name (full)", "people_w/ Nation", "people_w/_nation"]
    return safe_column_names(suppliers.toDF(*dirty))


# Unions, fills, footers


def _parties(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")
    )
    return customers, suppliers


@query
def union_by_name(spark, sf_dir):
    return combine.union_by_name(*_parties(spark, sf_dir))


@query
def union_positional(spark, sf_dir):
    customers, suppliers = _parties(spark, sf_dir)
    return combine.union_by_position(
        customers.select("key", "name"), suppliers.select(F.col("key").alias("id"), "name")
    )


@query
def back_fill(spark, sf_dir):
    return series.back_fill(inputs.patchy_tracker(spark, sf_dir), DATE, ["doses"])


@query
def drop_footer(spark, sf_dir):
    sheet = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"), "o_totalprice"
    )
    return cleaning.drop_footer(sheet, "row_idx")


@query
def drop_footer_by_sheet(spark, sf_dir):
    sheets = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row_idx"), "o_totalprice"
    )
    return cleaning.drop_footer(sheets, "row_idx", ["sheet"])


# Chat corpus


@query
def corpus_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return chat_corpus.load_split(documents, "lang", "en").select("doc_id", "text")


@query
def corpus_split_stored(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    folder = shared_folder(spark, "splits")
    chat_corpus.store_splits(documents, "lang", folder)
    return chat_corpus.load_split(spark.read.parquet(folder), "lang", "en").select("doc_id", "text")


@query
def sft_text(spark, sf_dir):
    return chat_corpus.conversation_texts(table(spark, sf_dir, "conversations"))


@query
def sft_truncate(spark, sf_dir):
    return chat_corpus.truncated_texts(table(spark, sf_dir, "conversations"))


@query
def sft_length_batches(spark, sf_dir):
    return chat_corpus.length_batches(sft_truncate(spark, sf_dir))


@query
def label_functions_in_sql(spark, sf_dir):
    register_sql_functions(spark)
    inputs.date_labels(spark, sf_dir).createOrReplaceTempView("trendline_labels")
    return spark.sql("""
        SELECT o_orderkey, label, compact_date(label) AS fixed, strip_week_token(label) AS stripped,
               join_range_label(CONCAT(o_orderkey, 'to', o_orderkey + 9)) AS keys
        FROM trendline_labels""")


# Pages


@query
def page_rows(spark, sf_dir):
    return page_tables.page_rows(
        table(spark, sf_dir, "pages"),
        "page_id",
        "html",
        row_pattern=r'<li>(<a href="[^"]*">[^<]*</a>)</li>',
        cell_pattern=r'(?:href="|">)([^"<]*)',
        width=2,
    )


@query
def page_rows_csv(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    folder = shared_folder(spark, "page-rows")
    text_files.write_csv(rows, folder, NULL_TEXT)
    return text_files.read_written_csv(spark, folder, rows.schema, NULL_TEXT)


@query
def page_assets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return page_tables.page_assets(pages, "page_id", "html", ["a", "script", "style", "div"])


@query
def page_grid(spark, sf_dir):
    """The lists of links as tables with a cell beside all rows and one above two columns."""
    html = F.col("html")
    for pattern, table_markup in (
        ("<ul>", '<table><tr><th rowspan="0">links</th><th colspan="2">target</th></tr>'),
        ('<li><a href="([^"]*)">([^<]*)</a></li>', "<tr><td>$2<td>$1</tr>"),
        ("</ul>", "</table>"),
    ):
        html = F.regexp_replace(html, pattern, table_markup)
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    rows = page_tables.page_grid(pages, "page_id", "html")
    cells = [F.get("cells", F.lit(place)).alias(f"c{place}") for place in range(3)]
    return rows.select("page_id", "table_idx", "row_idx", F.size("cells").alias("width"), *cells)


@query
def page_asset_list(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return page_tables.page_asset_list(pages, "page_id", "html", ["a"], ["href", "title"])


# Files and tables


def _csv_folder(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    folder = shared_folder(spark, "csv")
    text_files.write_csv(customers, folder, NULL_TEXT)
    return folder, customers.schema


@query
def read_csv_typed(spark, sf_dir):
    folder, schema = _csv_folder(spark, sf_dir)
    return text_files.read_written_csv(spark, folder, schema, NULL_TEXT)


@query
def read_csv_inferred(spark, sf_dir):
    folder, _ = _csv_folder(spark, sf_dir)
    return text_files.read_csv(spark, folder, nullValue=NULL_TEXT)


def _zip_folder(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day")
    )
    folder = shared_folder(spark, "zip")
    roundtrip.write_zipped_csv(orders, folder)
    return folder, orders.schema


@query
def read_zipped_csv(spark, sf_dir):
    return text_files.read_zipped_csv(spark, *_zip_folder(spark, sf_dir))


@query
def read_zipped_csv_source(spark, sf_dir):
    folder, _ = _zip_folder(spark, sf_dir)
    return zipped_source.read_zipped(spark, folder, "day date, o_orderkey long")


@query
def read_zipped_csv_inferred(spark, sf_dir):
    folder, _ = _zip_folder(spark, sf_dir)
    return text_files.read_zipped_csv(spark, folder)


def _workbook_folder(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    folder = shared_folder(spark, "workbooks")
    roundtrip.write_workbooks(parts, folder, "Results(1)")
    return folder, parts.schema


@query
def read_workbooks(spark, sf_dir):
    folder, schema = _workbook_folder(spark, sf_dir)
    return workbooks.read_sheet(spark, folder, "Results(1)", schema).drop("path", "row_idx")


@query
def read_workbooks_source(spark, sf_dir):
    folder, _ = _workbook_folder(spark, sf_dir)
    spark.dataSource.register(workbook_source.WorkbookSource)
    return spark.read.format("workbook").option("sheet", "Results(1)").load(folder)


@query
def read_workbooks_inferred(spark, sf_dir):
    folder, _ = _workbook_folder(spark, sf_dir)
    return workbooks.read_sheet(spark, folder, "Results(1)").drop("path", "row_idx")


@query
def replace_table(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    target = f"trendline_customer_{uuid.uuid4().hex}"
    tables.replace_table(table(spark, sf_dir, "supplier"), target)
    return tables.replace_table(customers, target)


@query
def sql_view_scan(spark, sf_dir):
    return tables.view_scan(table(spark, sf_dir, "customer"), "trendline customers")


@query
def sql_view_filter(spark, sf_dir):
    return tables.view_scan(
        table(spark, sf_dir, "customer"),
        "customers `by segment`",
        "c_mktsegment = :segment AND c_acctbal > :least",
        {"segment": "BUILDING", "least": 1000},
    )
