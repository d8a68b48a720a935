"""Tags and tables in the markup of a page."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Tasks get the classes below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose content is text whatever it looks like, elements that part words,
# row groups, and the largest spans of a cell.
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
BREAKS = "address blockquote br dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre section ul".split()
GROUPS = ("thead", "tbody", "tfoot")
MOST_COLUMNS = 1000
MOST_ROWS = 65534

# What follows a tag's name up to its end. All steps are possessive, so they need no stack.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']?+))*+"""
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    r"|<[!?/][^>]*+(?:>|\z)"
    rf"|<({RAW})(?=[\s/>]){_REST}(?:>.*?(?=</\1[\s/>]|\z)|\z)"
    rf"|<[a-z]{_REST}(?:>|\z)"
)
_NAME = r"^<([A-Za-z][^\s/>]*+)"
_TAG = rf"^<[A-Za-z][^\s/>]*+({_REST})>"
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+"""


def tags_of(text: Column, names: Sequence[str]) -> Column:
    """The tags of the page that open one of the elements, in order, as they are written.

    What stands in comments and in elements of raw text (scripts, styles, titles) is no tag; a tag
    that never ends is none either.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    wanted = [name.lower() for name in names]
    return F.filter(
        tokens,
        lambda token: F.lower(F.regexp_extract(token, _NAME, 1)).isin(wanted)
        & token.rlike(f"(?s){_TAG}"),
    )


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, _NAME, 1))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, references undecoded; NULL without one."""
    rest = F.regexp_extract(tag, f"(?s){_TAG}", 1)

    def all_of(group: int) -> Column:
        return F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(group))

    # Groups that took no part are empty, so the three ways to write a value add up to it.
    found = F.array_position(F.transform(all_of(1), F.lower), name.lower()).cast("int")
    value = F.concat(*[F.get(all_of(group), found - 1) for group in (2, 3, 4)])
    return F.when(found > 0, value)


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references as characters."""
    import html

    return texts.map(html.unescape, na_action="ignore")


class _Tables(HTMLParser):
    """The tables of a page in the order in which they open, as rows of cells with spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.raw = False

    def handle_starttag(self, tag, attributes):
        self.raw = tag in ("script", "style")
        if tag == "table":
            table = {"rows": [], "group": 0, "row": None, "cell": None}
            self.tables.append(table)
            self.open.append(table)
        elif not self.open:
            return
        elif tag in GROUPS:
            self._end_row()
            self.open[-1]["group"] += 1
        elif tag == "tr":
            self._end_row()
            self._start_row()
        elif tag in ("td", "th"):
            self._start_cell(dict(reversed(attributes)))
        elif tag in BREAKS:
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.raw = False
        if not self.open:
            return
        if tag == "table":
            self._end_row()
            self.open.pop()
            self.handle_data(" ")
        elif tag in ("tr", *GROUPS):
            self._end_row()
            self.open[-1]["group"] += tag in GROUPS
        elif tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif tag in BREAKS:
            self.handle_data(" ")

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None and not self.raw:
            self.open[-1]["cell"].append(data)

    def _start_row(self):
        table = self.open[-1]
        table["row"] = []
        table["rows"].append((table["group"], table["row"]))

    def _end_row(self):
        self.open[-1]["row"] = self.open[-1]["cell"] = None

    def _start_cell(self, attributes):
        table = self.open[-1]
        if table["row"] is None:
            self._start_row()
        table["cell"] = []
        columns = _span(attributes.get("colspan"), MOST_COLUMNS) or 1
        table["row"].append((table["cell"], columns, _span(attributes.get("rowspan"), MOST_ROWS)))


def _span(written: str | None, most: int) -> int:
    import re

    number = re.match(r"\s*\+?0*(\d{1,6})", written or "")
    return min(int(number[1]), most) if number else 1


def laid_out(rows) -> Iterator[list[str | None]]:
    """Rows of texts: a cell fills every place that it spans, places that no cell fills are None.

    A cell of row span 0 goes on to the end of its row group; no cell leaves its group. Where
    two cells would overlap, the earlier one keeps the place.
    """
    before, above = None, {}
    for row, (group, cells) in enumerate(rows):
        if group != before:
            before, above = group, {}
        # Per column the cells from above that are not at their end, the earliest first.
        above = {
            column: lasting
            for column, known in above.items()
            if (lasting := [(end, text) for end, text in known if end > row])
        }
        line = {column: known[0][1] for column, known in above.items()}
        place = 0
        for pieces, columns, height in cells:
            while place in line:
                place += 1
            text = " ".join("".join(pieces).split())
            end = row + height if height else float("inf")
            for column in range(place, place + columns):
                line.setdefault(column, text)
                if end > row + 1:
                    above.setdefault(column, []).append((end, text))
            place += columns
        yield [line.get(column) for column in range(max(line, default=-1) + 1)]


def page_grids(html: str) -> list[dict]:
    """All rows of all tables of a page."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [
        {"table_idx": number, "row_idx": row, "cells": cells}
        for number, table in enumerate(parser.tables)
        for row, cells in enumerate(laid_out(table["rows"]))
    ]


GRID_ROW = StructType(
    [
        StructField("table_idx", IntegerType()),
        StructField("row_idx", IntegerType()),
        StructField("cells", ArrayType(StringType())),
    ]
)


@F.pandas_udf(ArrayType(GRID_ROW))
def grids(texts: pd.Series) -> pd.Series:
    return texts.map(page_grids, na_action="ignore")
