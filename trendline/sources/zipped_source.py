"""Zipped CSV as a data source: ``spark.read.format("zipped_csv").load(folder)``."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from trendline.sources.files import addresses_below, first_places, folder_option, open_file
from trendline.sources.inference import typed
from trendline.sources.text_files import header_of, member_records

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_THREADS = 32


@dataclass
class Member(InputPartition):
    """One CSV member of one archive."""

    archive: str
    member: str


def members_of(archive: str) -> list[Member]:
    """The CSV members of an archive, from its directory alone."""
    import zipfile

    with open_file(archive) as stream, zipfile.ZipFile(stream) as opened:
        names = [name for name in opened.namelist() if name.lower().endswith(".csv")]
    return [Member(archive, name) for name in names]


def all_members(folder: str) -> list[Member]:
    with ThreadPoolExecutor(LISTING_THREADS) as threads:
        return [m for found in threads.map(members_of, addresses_below(folder, "zip")) for m in found]


def all_names(folder: str) -> list[str]:
    """The names of all headers, by the first place that they have in any."""

    def header(member: Member) -> list[str]:
        import zipfile

        with open_file(member.archive) as stream, zipfile.ZipFile(stream) as opened:
            return header_of(opened, member.member)

    with ThreadPoolExecutor(LISTING_THREADS) as threads:
        return first_places(threads.map(header, all_members(folder)))


class ZippedCsvReader(DataSourceReader):
    """A partition for each member; of a member's columns only those of the schema are kept."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self) -> list[Member]:
        return all_members(self.folder) or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        where = [pa.array([partition.archive]), pa.array([partition.member])]
        batch = pa.RecordBatch.from_arrays(where, ["archive", "member"])
        yield from member_records(iter([batch]), self.names)


class ZippedCsvSource(DataSource):
    """The CSV members of the zip files in a folder, their values as text.

    Columns are found by the header of each member; repeated headings are numbered from 2, a
    heading that is missing goes by its place. Without a schema the columns are all names of all
    headers. With one, its columns alone are parsed into rows; they have to be strings, as types are
    the work of ``read_zipped``. Folders without members have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> StructType:
        names = all_names(folder_option(self.options))
        return StructType([StructField(name, StringType()) for name in names])

    def reader(self, schema: StructType) -> ZippedCsvReader:
        other = [field.name for field in schema if not isinstance(field.dataType, StringType)]
        if other:
            raise ValueError(f"zipped_csv reads text; columns of other types: {', '.join(other)}")
        return ZippedCsvReader(folder_option(self.options), schema.fieldNames())


def read_zipped(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The columns of a schema from the zipped CSV files of a folder, unfit values as NULL."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = StructType([StructField(name, StringType()) for name in schema.fieldNames()])
    spark.dataSource.register(ZippedCsvSource)
    return typed(spark.read.format("zipped_csv").schema(texts).load(folder), schema)
