"""Tables and views."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from trendline.workspace import shared_folder


def read_table_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A name of one part as SQL text, whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def replace_table(df: DataFrame, target: str, path: str | None = None) -> DataFrame:
    """Puts the frame in place of an earlier table ``target`` and reads it back.

    A catalog of its own (``name.schema.table``) replaces the table in one step. In the session's
    catalog the rows are written to a fresh folder, below ``path`` or the shared storage. A table
    of the same columns is then moved there in one step of the catalog, so its name always has the
    old or the new rows. The catalog has no such step for other columns, for tables that keep their
    own files or for views: those are dropped and made anew, and if that fails, a table of files
    outside the catalog is put back. The folders of earlier versions stay until the caller removes them.
    """
    spark = df.sparkSession
    catalog = target.split(".")[0]
    own = spark.conf.get(f"spark.sql.catalog.{catalog}", None)
    if "." in target and own and catalog != "spark_catalog":
        df.writeTo(target).createOrReplace()
        return spark.table(target)
    folder = f"{path or shared_folder(spark, 'table')}/version-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    before = _stored_table(spark, target)
    if before is not None and before[0] == df.schema.simpleString():
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(target)
        return spark.table(target)
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    try:
        return spark.catalog.createTable(target, folder, "parquet")
    except Exception:
        if before is not None:
            spark.catalog.createTable(target, before[1], "parquet")
        raise


def _stored_table(spark: SparkSession, target: str) -> tuple[str, str] | None:
    """Columns and folder of a parquet table of files outside the catalog, if ``target`` is one."""
    if not spark.catalog.tableExists(target) or spark.catalog.getTable(target).tableType != "EXTERNAL":
        return None
    rows = spark.sql(f"DESCRIBE FORMATTED {target}").collect()
    facts = {row["col_name"]: row["data_type"] for row in rows}
    if facts.get("Provider", "").lower() != "parquet" or "# Partition Information" in facts:
        return None
    return spark.table(target).schema.simpleString(), facts["Location"]


def view_scan(
    df: DataFrame, view: str, condition: str | None = None, values: Mapping[str, Any] | None = None
) -> DataFrame:
    """Registers the frame as a temporary view and selects from it in SQL.

    The name may hold blanks and quotes. ``condition`` names its ``values`` as ``:name``; they
    are passed as arguments and are no part of the text.
    """
    df.createOrReplaceTempView(quoted(view))
    text = "SELECT * FROM IDENTIFIER(:_view)" + (f" WHERE {condition}" if condition else "")
    return df.sparkSession.sql(text, args={"_view": quoted(view), **(values or {})})
