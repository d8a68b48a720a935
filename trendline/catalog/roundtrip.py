"""Archives and workbooks written from tables, for the readers to read back.

Each task writes files of its own into the shared folder. A file name comes from
the partition and the batch, so a repeated task replaces its own files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendline.sources.files import write_file

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _write_files(df: DataFrame, folder: str, extension: str, fill) -> None:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        from pyspark import TaskContext

        task = TaskContext.get()
        partition, attempt = task.partitionId(), task.taskAttemptId()
        for number, batch in enumerate(batches):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                fill(archive, batch)
            name = f"{folder}/part-{partition:05d}-{number:05d}{extension}"
            write_file(name, buffer.getvalue(), attempt)
            yield pd.DataFrame({"file": [name]})

    df.mapInPandas(write, "file string").write.format("noop").mode("overwrite").save()


def write_zipped_csv(df: DataFrame, folder: str) -> None:
    """Zip files with one CSV member each."""
    header = ",".join(df.columns)

    def fill(archive, batch: pd.DataFrame) -> None:
        archive.writestr("data.csv", "\n".join([header, *batch["line"]]) + "\n")

    lines = df.select(F.to_csv(F.struct("*"), {"escape": '"'}).alias("line"))
    _write_files(lines, folder, ".zip", fill)


def write_workbooks(df: DataFrame, folder: str, sheet: str) -> None:
    """Workbooks with one sheet each; every cell is written as text."""
    columns = list(df.columns)

    def fill(archive, batch: pd.DataFrame) -> None:
        from xml.sax.saxutils import escape, quoteattr

        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"

        def row(values) -> str:
            cells = "".join(
                "<c/>" if value is None else f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                for value in values
            )
            return f"<row>{cells}</row>"

        rows = [row(columns), *map(row, batch.itertuples(index=False, name=None))]
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>'
            f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        archive.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
        )

    _write_files(df.select(*[F.col(c).cast("string") for c in columns]), folder, ".xlsx", fill)
