"""Page grids, asset lists and the SQL functions of labels."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from trendline.functions import labels
from trendline.functions.markup import laid_out
from trendline.functions.sql_functions import register_sql_functions
from trendline.plans import page_tables


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def grid(spark, html):
    rows = page_tables.page_grid(pages(spark, html), "page_id", "html")
    return [tuple(row)[1:] for row in rows.orderBy("table_idx", "row_idx").collect()]


def test_spans(spark):
    html = """<TABLE><thead><tr><th rowspan=2>unit<th colspan="2">cases &amp; tests</tr>
        <tr><td>a<td>b</thead><tbody><tr><td rowspan=0>x</td><td>1<td>2</tr><tr><td>3</tr></tbody>
        <tr><td colspan=0>end<br>here</td></tr></table>"""
    assert grid(spark, html) == [
        (0, 0, ["unit", "cases & tests", "cases & tests"]),
        (0, 1, ["unit", "a", "b"]),
        (0, 2, ["x", "1", "2"]),
        (0, 3, ["x", "3"]),
        (0, 4, ["end here"]),
    ]


def test_nested_tables_are_tables_of_their_own(spark):
    html = (
        "<table><tr><td>out<table><tr><td>in</table>er</td><td>z</td></tr></table>"
        "<p>no cell</p><td>none</td><table></table><table><tr><td>x<script>'<td>'</script></table>"
    )
    assert grid(spark, html) == [(0, 0, ["out er", "z"]), (1, 0, ["in"]), (3, 0, ["x"])]


def test_pages_without_tables(spark):
    none = pages(spark, None, "", "text", "<!-- <table><tr><td>x</table> -->")
    assert page_tables.page_grid(none, "page_id", "html").count() == 0
    assert grid(spark, "<table><tr><td>cut") == [(0, 0, ["cut"])]
    assert grid(spark, "<table><tr></tr><td>x") == [(0, 0, []), (0, 1, ["x"])]


def plain_layout(rows):
    """Every cell put on the grid on its own, groups one after another."""
    grid, start = {}, 0
    while start < len(rows):
        stop = start
        while stop < len(rows) and rows[stop][0] == rows[start][0]:
            stop += 1
        for row in range(start, stop):
            column = 0
            for pieces, columns, height in rows[row][1]:
                while (row, column) in grid:
                    column += 1
                last = stop if height == 0 else min(stop, row + height)
                for y in range(row, last):
                    for x in range(column, column + columns):
                        grid.setdefault((y, x), pieces[0])
                column += columns
        start = stop
    widths = [max((x for y, x in grid if y == row), default=-1) + 1 for row in range(len(rows))]
    return [[grid.get((row, x)) for x in range(width)] for row, width in enumerate(widths)]


def test_layout_against_plain_python():
    draw = random.Random(7)
    for _ in range(300):
        rows, group = [], 0
        for row in range(draw.randrange(7)):
            group += draw.random() < 0.2
            rows.append(
                (
                    group,
                    [
                        ([f"{row}.{cell}"], draw.choice((1, 1, 2, 3)), draw.choice((0, 1, 1, 2, 3)))
                        for cell in range(draw.randrange(4))
                    ],
                )
            )
        assert list(laid_out(rows)) == plain_layout(rows)


def assets(spark, html, *attributes):
    found = page_tables.page_asset_list(
        pages(spark, html), "page_id", "html", ["img", "script"], attributes or ["src", "width"]
    )
    return [tuple(row)[1:] for row in found.orderBy("asset_idx").collect()]


def test_assets_and_their_attributes(spark):
    html = """<!-- <img src=a> --><script src="s.js">"<img src=b>"</script><IMG SRC='c.png' width=3/>
        <img alt="src=no > here" src = "d?x=1&amp;y=2" src=second width><image src=e><img
        data-src=f><p it's><img src=g><style><img src=h></style><!--> <img src=i> <img src="""
    assert assets(spark, html) == [
        (0, "script", "s.js", None),
        (1, "img", "c.png", "3/"),
        (2, "img", "d?x=1&y=2", ""),
        (3, "img", None, None),
        (4, "img", "g", None),
        (5, "img", "i", None),
    ]


@pytest.mark.parametrize("html", [None, "", "<img", "<!-- <img src=x>", "<script><img src=x>"])
def test_no_assets(spark, html):
    assert [row for row in assets(spark, html) if row[1] == "img"] == []


def test_long_markup(spark):
    attributes = " ".join(f'a{n}="{n}"' for n in range(20000))
    html = f"<!-- {'x' * 300000} --><img {attributes} src=x>" + "<img <b " * 20000
    assert assets(spark, html) == [(0, "img", "x", None)]


def test_markup_needs_no_shuffle(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for found in (
        page_tables.page_grid(stored, "page_id", "html"),
        page_tables.page_asset_list(stored, "page_id", "html"),
    ):
        assert "Exchange" not in plan_of(found) and "url" not in plan_of(found)


def test_label_functions_in_sql(spark):
    register_sql_functions(spark)
    rows = [
        ("2020 Week20 May23 2021",),
        ("2021 Week01 Jan05",),
        ("2020 Jan02 2021",),
        ("12to17",),
        ("",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "text string")
    df.createOrReplaceTempView("label_texts")
    names = ("week_label_day", "compact_date", "strip_week_token", "join_range_label")
    calls = ", ".join(f"{name}(text)" for name in names)
    called = spark.sql(f"SELECT text, {calls} FROM label_texts")
    direct = df.select("text", *[getattr(labels, name)(F.col("text")) for name in names])
    assert values(called) == values(direct)
    assert "ArrowEvalPython" not in plan_of(called)
    register_sql_functions(spark)
    day = spark.sql("SELECT weekly_cutoff(DATE '2021-03-10') AS day").collect()[0]["day"]
    assert str(day) == "2021-03-09"
