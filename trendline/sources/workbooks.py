"""Sheets of spreadsheet workbooks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendline.sources.files import column_names, files_below
from trendline.sources.inference import inferred_schema, typed
from trendline.workspace import written_once

# Tasks get the functions below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BATCH = 4096
CELLS_SCHEMA = "path string, sheet string, row_idx bigint, cells array<string>"

# XML names of the workbook format, and its built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def _date_styles(book) -> set[int]:
    """Which cell styles show their number as a date."""
    import re
    from xml.etree import ElementTree

    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for code in root.iter(f"{MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.get("formatCode", ""))
        if re.search("[ymdhs]", bare, re.IGNORECASE):
            dates.add(int(code.get("numFmtId")))
    formats = root.find(f"{MAIN}cellXfs")
    styles = [] if formats is None else formats
    return {place for place, style in enumerate(styles) if int(style.get("numFmtId", 0)) in dates}


def _sheet_member(book, sheet: str | None) -> str | None:
    """The archive member of a sheet, found by the name on its tab; the first one without a name."""
    from xml.etree import ElementTree

    tabs = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    for tab in tabs.iter(f"{MAIN}sheet"):
        if sheet is None or tab.get("name") == sheet:
            target = targets[tab.get(RELATION_ID)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _column_number(reference: str) -> int:
    """``B7`` to 1."""
    number = 0
    for letter in filter(str.isalpha, reference):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _first_day(book):
    """Day 0 of the workbook's date system."""
    from datetime import datetime
    from xml.etree import ElementTree

    properties = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
    later = properties is not None and properties.get("date1904", "0") in ("1", "true", "on")
    return datetime(1904, 1, 1) if later else datetime(1899, 12, 30)


def _cell_text(cell, shared: list[str], dates: set[int], first_day) -> str | None:
    from datetime import timedelta

    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(part.text or "" for part in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        seconds = round(float(value) * 86400)
        return str(first_day + timedelta(seconds=seconds))
    return value


def _elements(book, member: str, tag: str) -> Iterator:
    """The elements of one kind in a member, one at a time; none is held after its turn."""
    from xml.etree import ElementTree

    with book.open(member) as xml:
        above = []
        for event, element in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == f"{MAIN}{tag}":
                yield element
                above[-1].clear()


def sheet_rows(stream, sheet: str | None) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and cells of one sheet of a workbook, a row at a time.

    The shared strings of the workbook are held as plain text, nothing else of it.
    """
    import zipfile

    with zipfile.ZipFile(stream) as book:
        member = _sheet_member(book, sheet)
        if member is None:
            return
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = _elements(book, "xl/sharedStrings.xml", "si")
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in strings]
        dates, first_day = _date_styles(book), _first_day(book)
        place = -1
        for element in _elements(book, member, "row"):
            place = int(element.get("r", place + 2)) - 1
            cells: list[str | None] = []
            for cell in element.iter(f"{MAIN}c"):
                number = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                cells.extend([None] * (number - len(cells)))
                cells.append(_cell_text(cell, shared, dates, first_day))
            yield place, cells


def aligned(rows, wanted: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """The rows below the header row, their cells in the order of the names."""
    _, header = next(rows, (0, []))
    places: list[int | None] = []
    width = -1
    for number, cells in rows:
        if len(cells) > width:
            width = max(len(cells), len(header))
            names = column_names(header, width)
            places = [names.index(name) if name in names else None for name in wanted]
        yield number, [
            cells[place] if place is not None and place < len(cells) else None for place in places
        ]


def sheet_cells(
    spark: SparkSession, path: str, sheet: str, names: list[str] | None = None
) -> DataFrame:
    """The cells of one sheet of every workbook in a folder.

    Without ``names``, all cells of all rows. With them, the rows below the header
    row, and of each only the named cells, wherever a workbook keeps them.

    Spark reads and spreads the workbooks, from any address that it knows; a task decodes
    one after another. Dates come as ISO text, errors and gaps as NULL. Workbooks without the sheet
    give no rows.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import itertools

        columns = ["path", "sheet", "row_idx", "cells"]
        for batch in batches:
            for address, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(io.BytesIO(content), sheet)
                rows = rows if names is None else aligned(rows, names)
                while chunk := list(itertools.islice(rows, ROWS_PER_BATCH)):
                    yield pd.DataFrame([(address, sheet, *row) for row in chunk], columns=columns)

    books = files_below(spark, path, "xlsx").select("path", "content")
    return books.mapInPandas(decode, CELLS_SCHEMA)


def _named(rows) -> Iterator[tuple[int | None, dict[str, str] | None, list[str] | None]]:
    """The rows below the header row as cells by name, and last the names of all columns."""
    _, header = next(rows, (0, []))
    names = column_names(header, 0)
    for number, cells in rows:
        if len(cells) > len(names):
            names = column_names(header, len(cells))
        known = zip(names, cells, strict=False)
        yield number, {name: cell for name, cell in known if cell is not None}, None
    yield None, None, names


def _stored_cells(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The cells by name of all workbooks, and a row of ``names`` for each, opened once and stored."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import itertools

        columns = ["path", "row_idx", "cells", "names"]
        for batch in batches:
            for address, content in zip(batch["path"], batch["content"], strict=True):
                rows = _named(sheet_rows(io.BytesIO(content), sheet))
                while chunk := list(itertools.islice(rows, ROWS_PER_BATCH)):
                    found = pd.DataFrame([(address, *row) for row in chunk], columns=columns)
                    yield found.astype({"row_idx": "Int64"})

    books = files_below(spark, path, "xlsx").select("path", "content")
    schema = "path string, row_idx bigint, cells map<string, string>, names array<string>"
    return written_once(books.mapInPandas(decode, schema), "sheet")


def read_sheet(
    spark: SparkSession, path: str, sheet: str, schema: StructType | None = None
) -> DataFrame:
    """A sheet as typed columns, found by their headings; unfit cells become NULL.

    Without a schema, the columns are all that any workbook has, named by heading or by place, and
    all their values decide on their types. Each workbook is opened once: its cells are stored, and
    names, types and rows come from there. ``path`` and ``row_idx`` stay, so that the rows
    keep their order.
    """
    if schema is not None:
        names = schema.fieldNames()
        rows = sheet_cells(spark, path, sheet, names)
        cells = [F.get("cells", F.lit(n)).alias(name) for n, name in enumerate(names)]
        return typed(rows.select("path", "row_idx", *cells), schema, "path", "row_idx")
    stored = _stored_cells(spark, path, sheet)
    columns = stored.select(F.posexplode("names").alias("place", "name"))
    first = columns.groupBy("name").agg(F.min("place").alias("place"))
    names = [row["name"] for row in first.orderBy("place", "name").collect()]
    rows = stored.filter("names IS NULL")
    texts = rows.select("path", "row_idx", *[F.col("cells")[name].alias(name) for name in names])
    schema = inferred_schema(texts.drop("path", "row_idx"))
    return typed(texts, schema, "path", "row_idx")
