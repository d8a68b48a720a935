"""CSV folders and zipped CSV."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendline.sources.files import check_scheme, column_names, files_below, open_file
from trendline.sources.inference import inferred_schema, typed
from trendline.workspace import written_once

# Tasks get the functions below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, **options: object
) -> DataFrame:
    """CSV with a header line. Without a schema, Spark reads the data once more to infer it."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def _escaped(text: Column) -> Column:
    """Text without line breaks: a backslash is doubled, a break becomes ``\\n`` or ``\\r``."""
    for sign, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    """What ``_escaped`` was given: breaks come back between doubled backslashes only."""

    def breaks(piece: Column) -> Column:
        piece = F.replace(piece, F.lit("\\n"), F.lit("\n"))
        return F.replace(piece, F.lit("\\r"), F.lit("\r"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), breaks), "\\")


def _texts(schema: StructType) -> list[str]:
    return [field.name for field in schema.fields if field.dataType == StringType()]


def write_csv(df: DataFrame, path: str, null_text: str = "") -> None:
    """CSV with a header line and one line per row.

    Quotes inside a value are doubled, NULL is ``null_text``, backslashes are doubled and line
    breaks written as ``\\n``, so that large files can be read in pieces.
    """
    escaped = df.withColumns({name: _escaped(F.col(f"`{name}`")) for name in _texts(df.schema)})
    escaped.write.mode("overwrite").options(header=True, escape='"', nullValue=null_text).csv(path)


def read_written_csv(
    spark: SparkSession, path: str, schema: StructType, null_text: str = ""
) -> DataFrame:
    """What ``write_csv`` wrote, values with line breaks included.

    Spark tells empty text from NULL only if ``null_text`` is not empty itself.
    """
    rows = read_csv(spark, path, schema, escape='"', nullValue=null_text)
    return rows.withColumns({name: _unescaped(F.col(f"`{name}`")) for name in _texts(schema)})


# Zipped CSV

MEMBERS = "archive string, member string"


def csv_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The CSV members of each archive, from its directory alone."""
    import zipfile

    for batch in batches:
        members = []
        for address in batch["path"]:
            with open_file(address) as stream, zipfile.ZipFile(stream) as archive:
                members += [(address, m) for m in archive.namelist() if m.lower().endswith(".csv")]
        yield pd.DataFrame(members, columns=["archive", "member"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def header_of(archive, member: str) -> list[str]:
    """The column names of a member, from its first record."""
    import csv
    import io

    with archive.open(member) as raw:
        first = next(csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")), [])
    return column_names(first, len(first))


def member_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column names of each member."""
    import zipfile

    for address, member in _members(batches):
        with open_file(address) as stream, zipfile.ZipFile(stream) as archive:
            names = pa.array([header_of(archive, member)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([member]), names], ["member", "names"])


def member_records(
    batches: Iterator[pa.RecordBatch], wanted: list[str]
) -> Iterator[pa.RecordBatch]:
    """The wanted columns of each member as text, found by its own header.

    The CSV parser reads a member as a stream, block by block. A column that a member lacks is
    NULL, a short record ends in NULLs, a record longer than the header is an error.
    """
    import csv as plain
    import zipfile

    from pyarrow import csv

    for address, member in _members(batches):
        short: list[list[str | None]] = []
        with open_file(address) as stream, zipfile.ZipFile(stream) as archive:
            names = header_of(archive, member)
            if not names:
                continue
            places = [names.index(name) if name in names else None for name in wanted]
            own = [f"_{place}" for place in range(len(names))]

            def keep_short(row, width=len(names), short=short) -> str:
                if row.actual_columns > width:
                    return "error"
                # As in full records, an empty cell is NULL and a quoted one is empty text.
                cells = next(plain.reader([row.text], quoting=plain.QUOTE_NOTNULL))
                short.append(cells + [None] * (width - len(cells)))
                return "skip"

            with archive.open(member) as raw:
                reader = csv.open_csv(
                    raw,
                    csv.ReadOptions(
                        block_size=BLOCK_BYTES,
                        column_names=own,
                        skip_rows_after_names=1,
                        use_threads=False,
                    ),
                    csv.ParseOptions(newlines_in_values=True, invalid_row_handler=keep_short),
                    csv.ConvertOptions(
                        column_types=dict.fromkeys(own, pa.string()),
                        null_values=[""],
                        strings_can_be_null=True,
                        quoted_strings_can_be_null=False,
                    ),
                )
                for block in reader:
                    yield _chosen(block.columns, block.num_rows, places, wanted)
            if short:
                columns = [pa.array(values, pa.string()) for values in zip(*short, strict=True)]
                yield _chosen(columns, len(short), places, wanted)


def _chosen(columns, rows: int, places: list[int | None], names: list[str]) -> pa.RecordBatch:
    nothing = pa.nulls(rows, pa.string())
    chosen = [nothing if place is None else columns[place] for place in places]
    return pa.RecordBatch.from_arrays(chosen, names)


def read_zipped_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Rows of the CSV members of the zip files in a folder.

    Each member has a header of its own, and columns are found by name. Quotes inside a value are
    doubled, and a quoted value may hold line breaks. With a schema, unfit and missing values are
    NULL. Without one, the columns are all names of all headers; the values are stored as text once,
    and all of them decide on their types.

    The members, not the archives, are spread over the tasks, so an archive with
    many members is shared out. One member is one stream and cannot be split.
    """
    check_scheme(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = files_below(spark, path, "zip").select("path")
    members = archives.mapInPandas(csv_members, MEMBERS).repartition(tasks)
    if schema is not None:
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return typed(_records(members, schema.fieldNames()), schema)
    headers = members.mapInArrow(member_headers, "member string, names array<string>")
    places = headers.select(F.posexplode("names").alias("place", "name"))
    first = places.groupBy("name").agg(F.min("place").alias("place"))
    names = [row["name"] for row in first.orderBy("place", "name").collect()]
    if not names:
        return spark.createDataFrame([], StructType())
    texts = written_once(_records(members, names), "zipped-csv")
    return typed(texts, inferred_schema(texts))


def _records(members: DataFrame, names: list[str]) -> DataFrame:
    schema = StructType([StructField(name, StringType()) for name in names])
    return members.mapInArrow(lambda batches: member_records(batches, names), schema)
