"""A training corpus out of the documents: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendline.llm import bpe, exact_dedup, mixing, quality, simhash
from trendline.llm.common import table, word_count
from trendline.workspace import written_once

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_wanted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, shingle_words=3, most_bits=2)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times."""
    columns = docs.columns
    sized = docs.select(
        F.struct(*columns).alias("_columns"),
        "doc_id",
        "source",
        word_count(docs["text"]).alias("size"),
    )
    return mixing.repeated(mixing.mix(sized), ["_columns"]).select("_columns.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every whole text, and their decoding as a digest."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.token_digests(docs.select("doc_id", "lang", "source", "text"), path)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", source_mix),
    ("BPE encoding", bpe_tokens),
]

# SQL can express neither the classifier nor the fingerprints' groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
