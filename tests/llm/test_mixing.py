"""Mixing sources to target weights."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import samples
from conftest import plan_of, values
from trendline.llm import mixing
from trendline.llm.common import word_count


def targets_of(sizes, weights=(5, 2, 1), most=3):
    """Excess is dealt again until no target is above its limit."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: weights[n % len(weights)] for n, name in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[name] for name in full)
        open_names = [name for name in names if name not in full]
        share = sum(weight[name] for name in open_names)
        found = {name: Fraction(most * sizes[name]) for name in full}
        found |= {name: Fraction(left * weight[name], share) for name in open_names}
        over = {name for name in open_names if found[name] > most * sizes[name]}
        if not over:
            return found
        full |= over


def mix_of(rows):
    """(key, size, source) to what is taken, in plain Python."""
    sizes = defaultdict(int)
    for _, size, source in rows:
        sizes[source] += size
    targets = targets_of(sizes)
    found = []
    for source, whole in sizes.items():
        budget = int(targets[source] + Fraction(1, 2))
        own = [row for row in rows if row[2] == source]

        def place(row):
            name = "" if row[0] is None else str(row[0])
            return hashlib.md5(f"mix:{name}".encode()).hexdigest(), row[0] or -1, row[1]

        before = 0
        epochs, rest = divmod(budget, whole) if whole else (0, 0)
        for key, size, _ in sorted(own, key=place):
            taken = epochs * size + max(0, min(size, rest - before))
            found.append((key, size, whole, round(float(targets[source]), 6), taken))
            before += size
    return sorted(found, key=repr)


def sized(docs):
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def test_mix_equals_plain_python(spark):
    docs = sized(samples.documents(spark))
    rows = [(row["doc_id"], row["size"], row["source"]) for row in docs.collect()]
    mixed = mixing.mix(docs)
    columns = ("doc_id", "size", "source_size", F.round("target", 6), "taken")
    assert values(mixed, *columns) == mix_of(rows)
    assert values(mixing.mix(docs.repartition(2)), *columns) == mix_of(rows)
    by_source = mixed.groupBy("source").agg(F.sum("taken"), F.first("target"))
    assert all(abs(taken - target) <= 0.5 for _, taken, target in by_source.collect())
    assert mixed.filter("taken > 3 * size").isEmpty()


def test_small_sources_stop_at_three_times_their_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, None: 500}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {row["source"]: row["target"] for row in mixing.source_targets(frame).collect()}
    expected = targets_of(sizes)
    assert found == {name: pytest.approx(float(target)) for name, target in expected.items()}
    assert found["a"] == 30 and found["c"] == 9 and found["d"] == 0


def test_copies_are_whole_documents(spark):
    docs = samples.documents(spark, clashes=True)
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("all"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(rows)
    again = mixing.repeated(mixed, ["all"]).select("all.*")
    assert again.columns == columns
    assert again.count() == mixed.agg(F.sum("copies")).collect()[0][0]
    near = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")), F.first("target"), F.max("size"))
    assert all(abs(taken - target) <= longest for _, taken, target, longest in near.collect())


def test_own_columns_give_way_to_new_ones(spark):
    docs = sized(samples.documents(spark)).withColumn("target", F.lit("old")).withColumn("_id", F.lit(1))
    mixed = mixing.mix(docs)
    assert mixed.columns.count("target") == 1 and dict(mixed.dtypes)["target"] == "double"
    assert "_id" in mixed.columns


def test_no_documents_and_no_words(spark):
    nothing = sized(samples.documents(spark, []))
    assert mixing.mix(nothing).collect() == []
    blank = sized(samples.documents(spark, [(1, None, None, None, None), (2, "", "x", "s", 0)]))
    assert values(mixing.mix(blank), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


def test_sources_are_dealt_by_slot_and_nothing_runs_in_python(spark):
    plan = plan_of(mixing.mix(sized(samples.documents(spark))))
    assert "Python" not in plan and "Arrow" not in plan
    assert "hashpartitioning(_source" in plan and "_slot" in plan
