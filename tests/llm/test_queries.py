"""The registered queries and the pipeline over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracles
import corpus_pipeline
import samples
from trendline.llm.queries import ORACLES, QUERIES

# Rows that a query returns for the rows of its table.
TABLES = {"op3": "embeddings", "op4": "pages", "op9": "conversations"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check_oracles.connect(sf_dir)


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_its_oracle(name, spark, sf_dir, connection):
    result = QUERIES[name](spark, sf_dir)
    assert check_oracles.compare(result, connection.execute(ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_for_each_row(name, spark, sf_dir):
    table = TABLES.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    expected = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert QUERIES[name](spark, sf_dir).count() == expected


def test_stages_follow_one_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf_dir).persist()
        assert left.columns == docs.columns, name
        counts.append(left.count())
        if name == "quality classifier":
            good = labels.filter("quality = 1 and toxic = 0").select("doc_id")
            assert left.join(good, "doc_id").count() >= 0.97 * docs.join(good, "doc_id").count()
            bad = labels.filter("quality = 0").select("doc_id")
            assert left.join(bad, "doc_id").count() < 0.3 * docs.join(bad, "doc_id").count()
        elif name == "exact dedup":
            assert left.select(F.lower("text")).distinct().count() == left.count()
            assert left.join(docs, "doc_id", "left_anti").isEmpty()
        elif name == "mixing sources":
            assert left.groupBy("doc_id").count().agg(F.max("count")).collect()[0][0] <= 3
            assert left.exceptAll(docs.union(docs).union(docs)).isEmpty()
        docs = left
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == counts[-1]
    assert tokens.filter("n_tokens is null").isEmpty()


def test_pipeline_runs(spark, sf_dir):
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert result.count() > 100


def test_stages_take_awkward_documents(spark, tmp_path):
    labels = spark.createDataFrame([(n, n % 3 // 2, 0) for n in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (samples.awkward_documents(), []):
        docs = samples.documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).persist()
            docs.count()
