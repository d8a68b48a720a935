"""Unions and lookups."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame


def union_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is NULL there."""
    return left.unionByName(right, allowMissingColumns=True)


def union_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right)


def rename_by_lookup(
    df: DataFrame, names: Mapping[str, str], key: str, out: str
) -> DataFrame:
    """Adds the new name of each row's key; rows whose key has none are left out.

    The lookup is a local relation: Spark knows its size and broadcasts it only
    if it is small.
    """
    lookup = pa.table({key: list(names.keys()), out: list(names.values())})
    return df.join(df.sparkSession.createDataFrame(lookup), key, "inner")
