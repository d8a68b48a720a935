"""What several corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case.

    Texts of ASCII alone, as many bytes as characters, take the faster way.
    """
    plain = F.octet_length(text) == F.char_length(text)
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(exact)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    count = F.regexp_count(text, F.lit(WORD_PATTERN))
    return F.coalesce(count, F.lit(0)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
