"""Column types found by looking at all values of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

# Narrowest first; a column gets the first type that all its values fit.
CANDIDATES = (
    IntegerType(),
    LongType(),
    DoubleType(),
    DateType(),
    TimestampType(),
    BooleanType(),
)


def _fits(text: Column, candidate: DataType) -> Column:
    if candidate == BooleanType():
        return F.lower(text).isin("true", "false")
    fits = text.try_cast(candidate).isNotNull()
    if candidate == DateType():
        return fits & (F.length(F.trim(text)) <= len("2021-01-02"))
    return fits


def inferred_schema(rows: DataFrame) -> StructType:
    """A schema that fits every row, found in one aggregation over all of them."""
    places = range(len(rows.columns))
    texts = rows.toDF(*[f"_{place}" for place in places])
    counts = texts.agg(
        *[F.count(f"_{place}") for place in places],
        *[
            F.count_if(_fits(F.col(f"_{place}"), candidate))
            for place in places
            for candidate in CANDIDATES
        ],
    ).collect()[0]
    schema = StructType()
    for place, name in enumerate(rows.columns):
        known = counts[place]
        start = len(places) + place * len(CANDIDATES)
        fitting = [c for n, c in enumerate(CANDIDATES) if known and counts[start + n] == known]
        schema.add(name, fitting[0] if fitting else StringType())
    return schema


def typed(rows: DataFrame, schema: StructType, *kept: str) -> DataFrame:
    """Text columns under the types of the schema; what does not fit becomes NULL."""
    columns = [
        F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name)
        for field in schema.fields
    ]
    return rows.select(*kept, *columns)
