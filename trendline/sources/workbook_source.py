"""Workbooks as a data source: ``spark.read.format("workbook").option("sheet", name).load(folder)``."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from trendline.sources import files, workbooks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_THREADS = 32
ROWS_PER_BATCH = 4096


@dataclass
class Workbook(InputPartition):
    """One workbook."""

    address: str


def header_of(address: str, sheet: str | None) -> list[str]:
    with files.open_file(address) as stream:
        _, header = next(workbooks.sheet_rows(stream, sheet), (0, []))
    return files.column_names(header, 0)


class WorkbookReader(DataSourceReader):
    """A partition for each workbook; of a sheet only the columns of the schema are kept."""

    def __init__(self, folder: str, sheet: str | None, headed: bool, names: list[str]):
        self.folder, self.sheet, self.headed, self.names = folder, sheet, headed, names

    def partitions(self) -> list[Workbook]:
        found = files.addresses_below(self.folder, "xlsx")
        return [Workbook(address) for address in found] or [Workbook("")]

    def read(self, partition: Workbook) -> Iterator[pa.RecordBatch]:
        import itertools

        if not partition.address:
            return
        width = len(self.names)
        with files.open_file(partition.address) as stream:
            rows = workbooks.sheet_rows(stream, self.sheet)
            if self.headed:
                rows = workbooks.aligned(rows, self.names)
            while chunk := list(itertools.islice(rows, ROWS_PER_BATCH)):
                cells = [(row + [None] * (width - len(row)))[:width] for _, row in chunk]
                columns = [pa.array(column, pa.string()) for column in zip(*cells, strict=True)]
                if not columns:
                    columns = [pa.nulls(len(chunk), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, self.names or ["_"])


class WorkbookSource(DataSource):
    """A sheet of every workbook of a folder, cells as text.

    Options: ``sheet`` (the first one of each workbook if missing) and ``header`` (true if missing).
    With a header, columns are found by the heading that each workbook gives them, repeats numbered
    from 2; without a schema they are all headings of all workbooks, read by the driver from the
    first rows alone. Without a header a schema is needed and names the columns by place. The schema's
    columns are strings: types are declared or inferred in one distributed pass by
    ``workbooks.read_sheet``, so ``inferSchema`` is refused here. The workbooks are streamed.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _headed(self) -> bool:
        return self.options.get("header", "true").lower() == "true"

    def schema(self) -> StructType:
        if self.options.get("inferSchema", "false").lower() == "true":
            raise ValueError("workbook reads text; workbooks.read_sheet infers types")
        if not self._headed():
            raise ValueError("workbook needs a schema where sheets have no header")
        folder, sheet = files.folder_option(self.options), self.options.get("sheet")
        with ThreadPoolExecutor(LISTING_THREADS) as threads:
            addresses = files.addresses_below(folder, "xlsx")
            headers = threads.map(lambda address: header_of(address, sheet), addresses)
            names = files.first_places(headers)
        return StructType([StructField(name, StringType()) for name in names])

    def reader(self, schema: StructType) -> WorkbookReader:
        other = [field.name for field in schema if not isinstance(field.dataType, StringType)]
        if other:
            raise ValueError(f"workbook reads text; columns of other types: {', '.join(other)}")
        folder, sheet = files.folder_option(self.options), self.options.get("sheet")
        return WorkbookReader(folder, sheet, self._headed(), schema.fieldNames())
