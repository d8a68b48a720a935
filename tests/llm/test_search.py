"""Exact top-k search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from trendline.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def best_of(rows, k=5):
    """Every query against every other row."""
    usable = []
    for place, (key, vector, _) in enumerate(rows):
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((place, key, [math.floor(256 * float(np.float32(x))) for x in vector]))
    found = []
    for place, key, query in usable:
        if key is None or key % 50:
            continue
        scored = [
            (-sum(a * b for a, b in zip(query, vector, strict=False)), other is None, other or 0)
            for at, other, vector in usable
            if at != place
        ]
        for rank, (score, missing, other) in enumerate(sorted(scored)[:k], 1):
            found.append((key, rank, None if missing else other, -score))
    return sorted(found, key=repr)


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, **options)
    return values(found, "query_id", "rank", "vec_id", "score")


def vectors(count, width=8, seed=3):
    draw = random.Random(seed)
    return [(n, [round(draw.gauss(0, 1), 2) for _ in range(width)], 0) for n in range(count)]


@pytest.mark.parametrize("rows_per_shard", [16_384, 700, 97])
def test_search_equals_brute_force(spark, rows_per_shard):
    rows = vectors(1500)
    assert search(spark, rows, rows_per_shard=rows_per_shard) == best_of(rows)


def test_awkward_vectors(spark):
    rows = vectors(120)
    rows += [(200, None, 1), (250, [float("nan"), 1.0], 1), (300, [1.0, None], 1), (350, [], 1)]
    rows += [(400, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (450, [1.0, -1.0], None)]
    rows += [(50, rows[50][1], 0), (500, rows[3][1], 0), (501, rows[3][1], 0), (550, [0.0] * 12, 0)]
    assert search(spark, rows, rows_per_shard=40) == best_of(rows)
    assert search(spark, rows) == best_of(rows)


def test_ties_go_to_smaller_keys(spark):
    rows = [(n, [1.0, 2.0], 0) for n in range(200)]
    assert search(spark, rows, rows_per_shard=30) == best_of(rows)


def test_few_rows_and_none(spark):
    assert search(spark, []) == []
    assert search(spark, [(50, [1.0], 0)]) == []
    assert search(spark, [(50, [1.0], 0), (7, [2.0], 0)]) == [(50, 1, 7, 256 * 512)]


def test_sums_beyond_doubles(spark):
    rows = [(n, [3.0e5 + n, -2.0e5, 1.0e5], 0) for n in range(60)]
    assert search(spark, rows) == best_of(rows)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(center, 5, (400, 6)) for center in (0, 400, -400)]).round()
    tree = topk.BallTree.build(points, leaf_rows=32)
    queries = points[::100]
    nodes = np.arange(len(tree.radius))
    bounds = tree.bounds(queries, nodes)
    for node in nodes:
        own = tree.vectors[tree.start[node] : tree.end[node]]
        assert (bounds[:, node] >= (queries @ own.T).max(axis=1)).all()
    least = np.full(len(queries), -np.inf)
    found = topk.search(tree, np.arange(len(points)), queries, np.full(len(queries), -1), least, 5)
    exact = np.sort(queries @ points.T, axis=1)[:, ::-1][:, :5]
    assert (found.score == exact).all()
    leaves = nodes[-(1 << tree.levels) :]
    assert (bounds[:, leaves] < found.score[:, -1:]).mean() > 0.4
