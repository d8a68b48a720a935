"""Folders and intermediate results that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "trendline"


def shared_base(spark: SparkSession) -> str:
    """The folder for intermediate results, shared by all executors.

    It lies below the session's ``spark.checkpoint.dir`` or, where that is unset,
    below ``spark.sql.warehouse.dir``, which every session has.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{OWN_FOLDER}"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name in the shared storage."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The frame, computed now and read back from the shared folder.

    For frames that several later steps read: they read only the columns they
    need, and losing an executor does not bring the computation back. ``codec``
    is that of the files, the session's if None.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_written(spark: SparkSession) -> bool:
    """Removes all intermediate results of this library from the shared storage.

    Frames that still read them fail afterwards, so call it when results are stored.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.delete(path, True)
