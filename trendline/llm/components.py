"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendline.workspace import written_once


def _mark(edges: DataFrame) -> tuple:
    """A few numbers that change when the set of edges does."""
    mixed = F.xxhash64("node", "root").cast("decimal(38,0)")
    row = edges.agg(F.count("*"), F.sum(mixed)).collect()[0]
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("_least"))
    moved = both.join(least.select("node", F.least("node", "_least").alias("_least")), "node")
    return moved.filter("other > node").select(
        F.col("other").alias("node"), F.col("_least").alias("root")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("node").agg(F.min("root").alias("_least"))
    moved = edges.join(least, "node").filter("root <> _least").select(
        F.col("root").alias("node"), F.col("_least").alias("root")
    )
    return moved.union(least.toDF("node", "root"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for all linked nodes but roots.

    ``links`` has two columns, a node and a smaller one. Large-star and small-star steps alternate
    until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. Each round is stored in the shared folder; only a count and a check sum of
    the edges come to the driver. A node with very many links is one key of joins whose
    other side has one row per key, which Spark can split. No links give no rows.
    """
    edges = written_once(links.toDF("node", "root").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        larger = written_once(_large_star(edges).distinct(), "edges")
        edges = written_once(_small_star(larger).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges
