"""Exact top-k by inner product: ball trees in shards, branch and bound."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_SHARD = 16_384
LEAF_ROWS = 128
QUERIES_AT_ONCE = 512
SLACK = 1e-9
EXACT_IN_DOUBLE = float(1 << 53)


@dataclass
class BallTree:
    """Nodes in breadth-first order; node i has the children 2i + 1 and 2i + 2.

    All leaves lie on the last level. ``start`` and ``end`` are the rows of a node
    in ``order``.
    """

    vectors: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    levels: int

    @classmethod
    def build(cls, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        """Splits at the median along the direction of the farthest pair, seen from the centre."""
        rows = len(vectors)
        levels = 0
        while rows > leaf_rows << levels:
            levels += 1
        nodes = (2 << levels) - 1
        order = np.arange(rows)
        center = np.zeros((nodes, vectors.shape[1]))
        radius = np.zeros(nodes)
        start, end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        end[0] = rows
        for node in range(nodes):
            a, b = start[node], end[node]
            own = vectors[order[a:b]]
            if b > a:
                center[node] = own.mean(axis=0)
                gaps = own - center[node]
                distances = np.einsum("ij,ij->i", gaps, gaps)
                radius[node] = np.sqrt(distances.max())
            if 2 * node + 2 < nodes:
                middle = (a + b) // 2
                if b - a > 1:
                    far = gaps[distances.argmax()]
                    other = gaps[((gaps - far) ** 2).sum(axis=1).argmax()]
                    order[a:b] = order[a:b][np.argpartition(gaps @ (far - other), middle - a)]
                start[2 * node + 1], end[2 * node + 1] = a, middle
                start[2 * node + 2], end[2 * node + 2] = middle, b
        return cls(vectors[order], order, center, radius, start, end, levels)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product that any vector of a node can have with a query."""
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        bound = queries @ self.center[nodes].T + lengths * self.radius[nodes]
        scale = np.abs(bound).max(initial=1.0)
        scale = scale + lengths * np.abs(self.center[nodes]).max(initial=1.0)
        return bound + SLACK * scale * self.vectors.shape[1]


class Best:
    """The k best of a block of queries so far: by score, ties by the order of ids."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.score = np.full((queries, k), -np.inf)
        self.place = np.full((queries, k), -1, np.int64)
        self.least = least

    def reached(self) -> np.ndarray:
        """A score below this one cannot be among the best."""
        return np.maximum(self.score[:, -1], self.least)

    def take(self, who: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        """Adds candidates; ``places`` number the vectors in the order of their ids."""
        k = self.score.shape[1]
        score = np.concatenate([self.score[who], scores], axis=1)
        place = np.concatenate(
            [self.place[who], np.broadcast_to(places, scores.shape)], axis=1
        )
        best = np.lexsort((place, -score), axis=1)[:, :k]
        self.score[who] = np.take_along_axis(score, best, axis=1)
        self.place[who] = np.take_along_axis(place, best, axis=1)


def search(
    tree: BallTree,
    places: np.ndarray,
    queries: np.ndarray,
    own: np.ndarray,
    least: np.ndarray,
    k: int,
) -> Best:
    """Branch and bound for a block of queries.

    Level by level, children stay in play while their bound reaches the score to
    beat. Then each query takes its leaves in the order of their bounds; queries
    that take the same leaf in the same round share one product, and each new kth
    score drops the leaves that can no longer count. ``own`` is the vector of a query
    itself, which does not count. A bound equal to the kth score still counts, for the tie.
    """
    best = Best(len(queries), k, least)
    who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    first_leaf = (1 << tree.levels) - 1
    for level in range(1, tree.levels + 1):
        nodes = np.arange((1 << level) - 1, (2 << level) - 1)
        bound = tree.bounds(queries, nodes)
        who = np.concatenate([who, who])
        node = np.concatenate([2 * node + 1, 2 * node + 2])
        alive = bound[who, node - nodes[0]] >= least[who]
        who, node = who[alive], node[alive]
    leaves = np.arange(first_leaf, len(tree.radius))
    bound = tree.bounds(queries, leaves)[who, node - first_leaf]
    order = np.lexsort((-bound, who))
    who, node, bound = who[order], node[order], bound[order]
    turn = np.arange(len(who)) - np.searchsorted(who, who)
    for round_number in range(turn.max(initial=-1) + 1):
        now = np.flatnonzero(turn == round_number)
        now = now[bound[now] >= best.reached()[who[now]]]
        if not len(now):
            break
        now = now[np.argsort(node[now], kind="stable")]
        for same in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
            leaf, some = node[same[0]], who[same]
            a, b = tree.start[leaf], tree.end[leaf]
            if a == b:
                continue
            scores = queries[some] @ tree.vectors[a:b].T
            numbers = places[tree.order[a:b]]
            scores[numbers[None, :] == own[some][:, None]] = -np.inf
            best.take(some, scores.astype(np.float64), numbers)
    return best


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component as a double; NULL unless all of them are finite numbers."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(values, lambda x: F.floor(x * F.lit(256.0)).cast("bigint"))
    return F.when(usable & ~F.exists(values, F.isnan), scaled)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a vector with fewer components ends in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(lengths), max(width, lengths.max(initial=0))), np.int64)
    found[np.arange(found.shape[1])[None, :] < lengths[:, None]] = flat
    return found


def _fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    more = width - matrix.shape[1]
    return np.pad(matrix, ((0, 0), (0, more))) if more > 0 else matrix


class _Shard:
    """The vectors of one shard: its tree is built when the first query comes."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tree = None

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch["id"].to_numpy(zero_copy_only=False)
        rows = batch["row"].to_numpy(zero_copy_only=False)
        self.parts.append((ids, rows, _matrix(batch["vector"], 0)))

    def build(self) -> None:
        width = max(part[2].shape[1] for part in self.parts)
        self.ids = np.concatenate([part[0] for part in self.parts])
        self.rows = np.concatenate([part[1] for part in self.parts])
        self.vectors = np.concatenate([_fitted(part[2], width) for part in self.parts])
        self.by_id = np.lexsort((self.rows, self.ids))
        self.places = np.empty(len(self.ids), np.int64)
        self.places[self.by_id] = np.arange(len(self.ids))
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.tree = BallTree.build(self.vectors.astype(np.float64))

    def answer(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.tree is None:
            self.build()
        width = self.vectors.shape[1]
        queries = _matrix(batch["vector"], width)
        rows = batch["row"].to_numpy(zero_copy_only=False)
        ids = batch["id"].to_numpy(zero_copy_only=False)
        least = batch["least"].to_numpy(zero_copy_only=False)
        sums = self.most * float(np.abs(queries).max(initial=0)) * max(width, 1)
        own = self._own(rows)
        queries = queries[:, :width]
        if sums < EXACT_IN_DOUBLE:
            found = search(
                self.tree, self.places, queries.astype(np.float64), own, least, self.k
            )
            score, place = found.score, found.place
        else:
            score, place = self._plain(queries, own)
        who, rank = np.nonzero(place >= 0)
        winners = self.by_id[place[who, rank]]
        columns = {
            "row": rows[who],
            "query_id": ids[who],
            "vec_row": self.rows[winners],
            "vec_id": self.ids[winners],
            "score": score[who, rank].astype(np.int64),
        }
        arrays = [pa.array(values, pa.int64()) for values in columns.values()]
        return pa.RecordBatch.from_arrays(arrays, list(columns))

    def _own(self, rows: np.ndarray) -> np.ndarray:
        """The place of the query itself, if it lies in this shard."""
        order = np.argsort(self.rows, kind="stable")
        at = np.minimum(np.searchsorted(self.rows[order], rows), len(order) - 1)
        hit = self.rows[order][at] == rows
        return np.where(hit, self.places[order][at], -1)

    def _plain(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums too large for doubles: whole numbers of any size against every vector."""
        score = np.full((len(queries), self.k), 0, object)
        place = np.full((len(queries), self.k), -1, np.int64)
        vectors = self.vectors.astype(object)
        for number, query in enumerate(queries.astype(object)):
            sums = vectors @ query
            ranked = sorted(range(len(sums)), key=lambda i: (-sums[i], self.places[i]))
            ranked = [i for i in ranked if self.places[i] != own[number]][: self.k]
            limit = (1 << 63) - 1
            score[number, : len(ranked)] = [max(-limit - 1, min(limit, sums[i])) for i in ranked]
            place[number, : len(ranked)] = self.places[ranked]
        return score, place


FOUND = "row bigint, query_id bigint, vec_row bigint, vec_id bigint, score bigint"
NO_ID = (1 << 63) - 1


def _searched(vectors: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """Partial results of queries against the shards they are dealt to."""
    both = vectors.select(
        "shard", F.lit(0).alias("kind"), "id", "row", "vector", F.lit(0.0).alias("least")
    ).union(queries.select("shard", F.lit(1), "id", "row", "vector", "least"))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = None, None
        for batch in batches:
            marks = np.stack(
                [batch["shard"].to_numpy().astype(np.int64), batch["kind"].to_numpy()]
            )
            cuts = np.flatnonzero(np.any(np.diff(marks, axis=1) != 0, axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if marks[0, a] != current:
                    shard, current = _Shard(k), marks[0, a]
                if marks[1, a] == 0:
                    shard.add(batch.slice(a, b - a))
                elif shard.parts:
                    for start in range(a, b, QUERIES_AT_ONCE):
                        size = min(QUERIES_AT_ONCE, b - start)
                        yield shard.answer(batch.slice(start, size))

    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    in_order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best of every query.

    The vectors are dealt by hash into shards of some 16,000 rows, each with a ball tree. Every
    query first searches its own shard; the kth score found there goes with it to the other shards,
    where nodes that cannot reach it are never opened. Queries are streamed through a shard in
    blocks, so only one shard's vectors and one block are in memory, and only k rows per query and
    shard come back.

    Scores are exact: sums that do not fit a double are computed in whole numbers, held to the range
    of a long. Ties go to the smaller key. A shorter vector counts as ending in zeros. Vectors that
    are NULL or hold NULL or non-finite components take no part; a NULL key comes last among ties.
    Rows that repeat a key are rows of their own. Fewer than k other rows give fewer results.
    """
    usable = vectors.select(
        F.coalesce(vectors[key].cast("bigint"), F.lit(NO_ID)).alias("id"),
        quantised(vectors[vector]).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    ).filter(F.col("vector").isNotNull())
    usable = written_once(usable, "vectors")
    shards = max(1, -(-usable.count() // rows_per_shard))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    usable = usable.withColumn("shard", home)
    asking = usable.filter("asks")
    least = F.lit(float("-inf"))
    first = written_once(_searched(usable, asking.withColumn("least", least), shards, k), "first")
    kth = _best(first, k).filter(F.col("rank") == k).select("row", F.col("score").alias("_kth"))
    others = F.sequence(F.lit(1), F.lit(shards - 1)) if shards > 1 else F.array().cast("array<int>")
    away = (
        asking.join(kth, "row", "left")
        .withColumn("least", F.coalesce(F.col("_kth").cast("double"), least))
        .withColumn("_step", F.explode(others))
        .withColumn("shard", ((F.col("shard") + F.col("_step")) % F.lit(shards)).cast("int"))
    )
    found = first
    if shards > 1:
        found = first.union(_searched(usable, away, shards, k))
    known = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return _best(found, k).select(
        F.when(F.col("query_id") != NO_ID, F.col("query_id")).alias("query_id"),
        F.col("rank").cast("int").alias("rank"),
        known.alias("vec_id"),
        "score",
    )
