"""Language-model scores by deleted interpolation."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.llm.common import word_count
from trendline.llm.hashing import MIX, PrefixHash, mixed
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS = 7
SCORED_FOLD = 2  # is not learnt from
WEIGHT_FOLD = 3  # of the training documents: the held-out counts that the weights are learnt on
BLOCK_BYTES = 8 << 20
BYTES_AT_ONCE = 1 << 20
SHARD_TOKENS = 3 << 20
COUNTS_AT_ONCE = 1 << 20
PARTS = 8
HOT_SHARE = 4_000
HOT_PAIR_SHARE = 8_000
STEPS_PER_OCTAVE = 4
OCTAVES = 40  # above uniform, and as many below
MOST_STEPS = STEPS_PER_OCTAVE * OCTAVES
CELLS = 2 * MOST_STEPS + 2
ROUNDS = 200

END = np.uint64(0x9D8A7C6B5E4F3021)
TESTED, TUNED, LEARNT = 0, 1, 2


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 7; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(FOLDS)


class Tokens:
    """The tokens of a block of texts: words with A-Z in lower case, and one end each.

    A token is known by a 64-bit hash of its bytes. Its context is the token before it; for the
    first it is the end of a text, which is nobody else's context and occurs as often.
    """

    def __init__(self, hashes: PrefixHash, texts: list[bytes]):
        parts = [
            (start, *self._hashed(hashes, some)) for start, some in _pieces(texts, BYTES_AT_ONCE)
        ]
        self.doc = np.concatenate([doc + start for start, doc, _, _ in parts])
        self.token = np.concatenate([token for _, _, token, _ in parts])
        self.context = np.concatenate([context for _, _, _, context in parts])

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct tokens in order, and the places among them of each token and each context.

        A context is the token before, or the end that every text has, so one sort is enough.
        """
        distinct, token = np.unique(self.token, return_inverse=True)
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[_runs(self.doc)] = np.searchsorted(distinct, END)
        return distinct, token, context

    @staticmethod
    def _hashed(
        hashes: PrefixHash, texts: list[bytes]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        upper = (data >= 65) & (data <= 90)
        data = data + (upper * np.uint8(32))
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        inside = np.concatenate(([False], ~blank, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
        counts = np.bincount(owner, minlength=len(texts))
        # One more place per text, for its end.
        last = np.cumsum(counts + 1) - 1
        token = np.empty(len(starts) + len(texts), np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[last] = True
        token[is_end] = END
        token[~is_end] = hashes.stretches(data, starts, stops)
        context = np.empty(len(token), np.uint64)
        context[1:] = token[:-1]
        context[np.concatenate(([0], last[:-1] + 1))] = END
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts + 1)
        return doc, token, context


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the place of the first."""
    start, size = 0, 0
    for place, text in enumerate(texts):
        size += len(text) + 1
        if size >= most:
            yield start, texts[start : place + 1]
            start, size = place + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of a batch in blocks of bounded size; a block has fewer than 65,536 texts."""
    start, size, block = 0, 0, []
    for place in range(batch.num_rows):
        text = batch["text"][place].as_py().encode("utf-8", "surrogatepass")
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES or len(block) >= 1 << 15:
            yield slice(start, place + 1), block
            start, size, block = place + 1, 0, []
    if block:
        yield slice(start, start + len(block)), block


def _pair_key(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(token * np.uint64(MIX) + context)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each block: over all, training and weight-learning texts.

    A row is a token (``context`` is NULL), or a pair that makes up at least an 8,000th of the block.
    """
    hashes = PrefixHash(2 * BYTES_AT_ONCE)
    for batch in batches:
        folds = batch["fold"].to_numpy()
        for part, texts in _blocks(batch):
            tokens = Tokens(hashes, texts)
            token, place = np.unique(tokens.token, return_inverse=True)
            part_of = folds[part].astype(np.int64)[tokens.doc]
            by_fold = np.bincount(place * 3 + part_of, minlength=3 * len(token)).reshape(-1, 3)
            learnt = by_fold[:, LEARNT]
            counts = [by_fold.sum(axis=1), by_fold[:, TUNED] + learnt, learnt]
            often = (counts[0] * HOT_PAIR_SHARE >= len(place))[place]
            context, after = np.unique(tokens.context[often], return_inverse=True)
            pair = place[often] * max(1, len(context)) + after
            pair, times = np.unique(pair, return_counts=True)
            pair, times = (values[times * HOT_PAIR_SHARE >= len(place)] for values in (pair, times))
            rest = np.zeros(len(pair), np.int64)
            of_pair, after = np.divmod(pair, max(1, len(context)))
            single = np.arange(len(token) + len(pair)) < len(token)
            context = np.append(np.zeros(len(token), np.uint64), context[after])
            columns = {
                "token": np.append(token, token[of_pair]).view(np.int64),
                "n_all": np.append(counts[0], times),
                "n": np.append(counts[1], rest),
                "n_learnt": np.append(counts[2], rest),
            }
            arrays = {name: pa.array(values, pa.int64()) for name, values in columns.items()}
            arrays["context"] = pa.array(context.view(np.int64), pa.int64(), mask=single)
            names = ["token", "context", "n_all", "n", "n_learnt"]
            yield pa.RecordBatch.from_arrays([arrays[name] for name in names], names)


def _places(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted known ones, and the places of those."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    found = known[place] == values
    return found, place[found]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted rows, a new combination of keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return np.flatnonzero(new)


def _combined(*columns: np.ndarray) -> np.ndarray:
    """One number a row, in the order of the first column, then of the second one, and so on.

    Sorting it is much faster than sorting by one column after the other. Where the numbers would
    pass 63 bits, those so far are replaced by their ranks.
    """
    key, width = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        most = int(column.max(initial=0)) + 1
        if most > 2 * len(column):
            values, column = np.unique(column, return_inverse=True)
            most = len(values)
        if width * most >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            width = len(values)
        key = key * np.int64(most) + column
        width *= most
    return key


@dataclass
class Statistics:
    """What all tasks know of the corpus; its size does not depend on the corpus.

    Arrays have one place per hot token (one that makes up at least a 4,000th of all tokens, so
    there are at most 4,000), or per hot pair of token and context (one that makes up at least three
    8,000ths in the blocks where it is frequent; every pair that makes up four 8,000ths of all is
    among them, and its token is hot).
    """

    tokens: int
    distinct: int
    tokens_learnt: int
    distinct_learnt: int
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_counts_learnt: np.ndarray
    pairs: np.ndarray
    shards: int
    pair_counts: np.ndarray | None = None


def _deal(known: Statistics):
    """Occurrences of each block, packed by shard.

    A shard has all occurrences of its tokens; those of a hot token are dealt by context as well,
    and those of a hot pair by document. A block's keys come under shards from -1 down. A row holds,
    in order of token and context: the tokens, how many contexts each has, the places of those among
    the row's contexts, how many documents each of them has, the documents, and how often it is in
    them; then the contexts, the places in the block and the folds of its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = PrefixHash(2 * BYTES_AT_ONCE)
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            folds, keys = batch["fold"].to_numpy(), batch["key"].to_numpy()
            for part, texts in _blocks(batch):
                block += 1
                own_keys, own_folds = keys[part], folds[part]
                yield _packed(-1 - block % known.shards, block, {"keys": own_keys})
                found = Tokens(hashes, texts)
                distinct, number, before = found.numbered()
                key = _combined(number, before, found.doc)
                order = np.argsort(key)
                key = key[order]
                entries = _runs(key)
                times = np.diff(np.append(entries, len(key)))
                order = order[entries]
                number, doc = number[order], found.doc[order]
                token, context = distinct[number], distinct[before[order]]
                shard = token.copy()
                hot = _places(known.hot, distinct)[0][number]
                pair = _pair_key(token[hot], context[hot])
                crowd, _ = _places(known.pairs, pair)
                if crowd.any():
                    pair[crowd] += own_keys[doc[hot][crowd]].view(np.uint64)
                shard[hot] = pair
                shard = mixed(shard) % np.uint64(known.shards)
                shard = shard.astype(np.uint16 if known.shards <= 1 << 16 else np.int32)
                order = np.argsort(shard, kind="stable")
                cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=known.shards)))
                for number in range(known.shards):
                    own = order[cuts[number] : cuts[number + 1]]
                    if len(own):
                        values = (token[own], context[own], doc[own], times[own])
                        yield _packed(number, block, _occurrences(*values, own_folds))

    return run


PACKED = (
    "shard int, block bigint, tokens binary, pairs_of binary, after binary, docs_of binary, "
    "docs binary, times binary, contexts binary, places binary, folds binary, keys binary"
)
FIELDS = {
    "tokens": np.uint64,
    "pairs_of": np.uint32,
    "after": np.uint32,
    "docs_of": np.uint32,
    "docs": np.uint16,
    "times": np.uint32,
    "contexts": np.uint64,
    "places": np.uint16,
    "folds": np.uint8,
    "keys": np.int64,
}
COUNTS = {"context": np.uint64, "context_n": np.int64, "context_n_learnt": np.int64}
QUESTIONS = {"context": np.uint64, "asking": np.uint32}
# Of a shard: what its events are, the events of each of its documents, whose documents these are;
# and its held-out events.
EVENTS = {
    "n": np.int64,
    "context_n": np.int64,
    "token_n": np.int64,
    "events_of": np.uint32,
    "event": np.uint32,
    "event_times": np.uint32,
    "blocks": np.int64,
    "docs_of_block": np.uint32,
    "places": np.uint16,
}
CELLS_OF = {"cells": np.int64, "cell_counts": np.int64}
STORED = {**EVENTS, **CELLS_OF, "keys": np.int64}
SUMS = {"places": np.uint16, "n_known": np.uint32, "base": np.float64, "score": np.float64}


def _occurrences(token, context, doc, times, folds) -> dict[str, np.ndarray]:
    tokens = _runs(token)
    pairs = _runs(token, context)
    pairs_of = np.diff(np.append(np.searchsorted(pairs, tokens), len(pairs)))
    contexts, after = np.unique(context[pairs], return_inverse=True)
    shown = np.bincount(doc) > 0
    used, place = np.flatnonzero(shown), (np.cumsum(shown) - 1)[doc]
    return {
        "tokens": token[tokens],
        "pairs_of": pairs_of,
        "after": after,
        "docs_of": np.diff(np.append(pairs, len(token))),
        "docs": place,
        "times": times,
        "contexts": contexts,
        "places": used,
        "folds": folds[used],
    }


def _packed(
    shard: int, block: int, values: dict[str, np.ndarray], fields: dict[str, type] = FIELDS
) -> pa.RecordBatch:
    """One row of arrays; those that are not given are NULL.

    First come the first bytes of all numbers, then the second ones, and so on: small numbers in
    wide types leave long runs of zeros.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    arrays = [pa.array([shard], pa.int32()), pa.array([block], pa.int64())]
    for name, kind in fields.items():
        packed = None
        if name in values:
            numbers = np.ascontiguousarray(values[name], kind)
            packed = pack(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())
        arrays.append(pa.array([packed], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["shard", "block", *fields])


def _unpacked(
    batches: Iterator[pa.RecordBatch], fields: dict[str, type]
) -> Iterator[dict[str, np.ndarray]]:
    """The rows, each with its shard, its block and those of its arrays that are not NULL."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for place in range(batch.num_rows):
            row = {name: batch[name][place].as_py() for name in ("shard", "block")}
            for name, kind in fields.items():
                value = batch[name][place]
                if value.is_valid:
                    planes = np.frombuffer(unpack(value.as_buffer()), np.uint8)
                    planes = planes.reshape(np.dtype(kind).itemsize, -1)
                    row[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
            yield row


class Shard:
    """All occurrences of some tokens, over all blocks."""

    def __init__(
        self,
        known: Statistics,
        rows: list[dict[str, np.ndarray]],
        counts: dict[str, np.ndarray],
    ):
        parts: dict[str, list[np.ndarray]] = {
            name: [] for name in ("token", "context", "doc", "times", "folds")
        }
        docs = 0
        for row in rows:
            pair_token = np.repeat(row["tokens"], row["pairs_of"])
            parts["token"].append(np.repeat(pair_token, row["docs_of"]))
            parts["context"].append(np.repeat(row["contexts"][row["after"]], row["docs_of"]))
            parts["doc"].append(row["docs"].astype(np.int32) + np.int32(docs))
            for name in ("times", "folds"):
                parts[name].append(row[name])
            docs += len(row["places"])
        merged = {name: np.concatenate(parts.pop(name)) for name in list(parts)}
        order = np.argsort(_combined(merged["token"], merged["context"])).astype(np.int32)
        token, context = merged.pop("token")[order], merged.pop("context")[order]
        self.doc, self.times = merged.pop("doc")[order], merged.pop("times")[order]
        folds = merged["folds"][self.doc]
        del order
        first = _runs(token, context)
        of_pair = np.diff(np.append(first, len(token)))
        self.pair = np.repeat(np.arange(len(first), dtype=np.int32), of_pair)
        context = context[first]
        self.n, self.n_learnt, self.n_tuned = (
            np.bincount(self.pair, self.times * chosen, minlength=len(first)).astype(np.int64)
            for chosen in (folds != TESTED, folds == LEARNT, folds == TUNED)
        )
        # The count of a token: here, as all its pairs are here, or from the list of hot tokens.
        token = token[first]
        of_token = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
        self.token_n, self.token_n_learnt = (
            np.bincount(of_token, values).astype(np.int64)[of_token]
            for values in (self.n, self.n_learnt)
        )
        hot, place = _places(known.hot, token)
        self.token_n[hot] = known.hot_counts[place]
        self.token_n_learnt[hot] = known.hot_counts_learnt[place]
        # A hot pair is in many shards; how often it occurs in all of them is known as well.
        if known.pair_counts is not None:
            crowd, place = _places(known.pairs, _pair_key(token, context))
            self.n[crowd] = known.pair_counts[0][place]
            self.n_learnt[crowd] = known.pair_counts[1][place]
        # The count of a context: as of a token, but most of its occurrences are in other shards.
        self.context_n, self.context_n_learnt = np.zeros((2, len(context)), np.int64)
        hot, place = _places(known.hot, context)
        self.context_n[hot] = known.hot_counts[place]
        self.context_n_learnt[hot] = known.hot_counts_learnt[place]
        rest, place = _places(counts["context"], context)
        if not (hot | rest).all():
            raise ValueError("a context has no count")
        self.context_n[rest] = counts["context_n"][place]
        self.context_n_learnt[rest] = counts["context_n_learnt"][place]


def _parts(rows: list[dict[str, np.ndarray]]) -> Iterator[list[dict[str, np.ndarray]]]:
    """The rows of a shard in parts by token, so that only some of them are unpacked at a time."""
    for part in range(PARTS):
        found = []
        for row in rows:
            token = mixed(row["tokens"] ^ np.uint64(MIX)) % np.uint64(PARTS) == part
            pair = np.repeat(token, row["pairs_of"])
            entry = np.repeat(pair, row["docs_of"])
            chosen = {"tokens": token, "pairs_of": token, "after": pair, "docs_of": pair}
            chosen |= {"docs": entry, "times": entry}
            own = {name: row[name][marks] for name, marks in chosen.items()}
            found.append({**row, **own})
        if any(len(row["tokens"]) for row in found):
            yield found


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """The bucket of a context: the binary logarithm of how often it occurs."""
    return np.log2(context_count + 1.0).astype(np.int64)


def _cell(ratio: np.ndarray) -> np.ndarray:
    """A ratio to the uniform probability as a step on a logarithmic scale; 0 if it is 0.

    Ratios from 1 up take the cells from 1 up, those below 1 the cells from the last down.
    """
    with np.errstate(divide="ignore"):
        steps = np.round(np.log2(ratio) * STEPS_PER_OCTAVE)
    steps = np.clip(steps, -MOST_STEPS, MOST_STEPS)
    cell = np.where(steps < 0, CELLS + steps, steps + 1)
    return np.where(ratio > 0, cell, 0).astype(np.int64)


def _ratio(cell: np.ndarray) -> np.ndarray:
    """The ratio that a cell stands for."""
    steps = np.where(cell > MOST_STEPS + 1, cell - CELLS, cell - 1)
    return np.where(cell > 0, 2.0 ** (steps / STEPS_PER_OCTAVE), 0.0)


def held_out_cells(known: Statistics, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """How often held-out texts show each combination of context bucket and component ratios."""
    seen = np.flatnonzero(shard.n_tuned)
    count = shard.context_n_learnt[seen]
    uniform = known.distinct_learnt + 1.0
    pair = shard.n_learnt[seen] / np.maximum(count, 1) * uniform
    single = shard.token_n_learnt[seen] / max(1, known.tokens_learnt) * uniform
    cell = (bucket_of(count) * CELLS + _cell(pair)) * CELLS + _cell(single)
    found, place = np.unique(cell, return_inverse=True)
    return found, np.bincount(place, shard.n_tuned[seen]).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, buckets: int = 64) -> np.ndarray:
    """Mixture weights (pair, single, uniform) of each bucket by expectation-maximisation.

    Each cell stands for events of the same bucket and the same component probabilities. One event
    more per component keeps every weight above zero; a bucket without events gets the weights of
    all buckets together.
    """
    bucket, rest = np.divmod(cells, CELLS * CELLS)
    ratios = np.stack([*map(_ratio, np.divmod(rest, CELLS)), np.ones(len(rest))])

    def fit(chosen: np.ndarray) -> np.ndarray:
        own, n = ratios[:, chosen], counts[chosen]
        weights = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            shares = weights[:, None] * own
            expected = (shares / shares.sum(axis=0) * n).sum(axis=1) + 1.0
            new = expected / expected.sum()
            if np.abs(new - weights).max() < 1e-9:
                break
            weights = new
        return weights

    overall = fit(np.ones(len(cells), bool))
    found = np.tile(overall, (buckets, 1))
    for number in np.unique(bucket):
        found[number] = fit(bucket == number)
    return found


def _log10_probabilities(
    known: Statistics, events: dict[str, np.ndarray], weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of each event: the model's probability and that of add-one counts."""
    count = events["context_n"]
    weight = weights[bucket_of(count)]
    model = (
        weight[:, 0] * events["n"] / np.maximum(count, 1)
        + weight[:, 1] * events["token_n"] / max(1, known.tokens)
        + weight[:, 2] / (known.distinct + 1)
    )
    base = (events["token_n"] + 1) / (known.tokens + 1 * (known.distinct + 1))
    return np.log10(model), np.log10(base)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their times."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    sums = np.add.reduceat(times[order], first, dtype=np.int64) if len(first) else times
    return keys[first], sums


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct combinations of some columns, and for each place the number of its combination."""
    key = _combined(*columns[::-1])
    order = np.argsort(key)
    first = _runs(key[order])
    columns = columns[:, order]
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return columns[:, first], number


def _events(
    known: Statistics, rows: list[dict[str, np.ndarray]], counts: dict[str, np.ndarray]
) -> dict[str, np.ndarray]:
    """What the weights and the scores need of a shard: its events by document, and its cells.

    An event is a combination of the three counts that a probability comes from. Events are numbered
    from the most frequent one on; most numbers so are small. Takes rows and counts apart, so that
    they are not held longer than needed.
    """
    combined, docs, events, times, cells = [], [], [], [], []
    start = 0
    for part in _parts(rows):
        shard = Shard(known, part, counts)
        cells.append(held_out_cells(known, shard))
        of_part, number = _distinct(np.stack([shard.n, shard.context_n, shard.token_n]))
        width = of_part.shape[1]
        entry, of_entry = _summed(shard.doc * np.int64(width) + number[shard.pair], shard.times)
        combined.append(of_part)
        docs.append((entry // width).astype(np.uint32))
        events.append((entry % width + start).astype(np.uint32))
        times.append(of_entry.astype(np.uint32))
        start += width
        del shard, part, number, entry, of_entry
    blocks = np.array([row["block"] for row in rows])
    places = [row["places"] for row in rows]
    rows.clear()
    counts.clear()
    combined, number = _distinct(np.concatenate(combined, axis=1))
    doc, event = np.concatenate(docs), np.concatenate(events)
    del docs, events
    event = number[event].astype(np.uint32)
    often = np.argsort(-np.bincount(event, minlength=combined.shape[1]), kind="stable")
    number = np.empty(len(often), np.uint32)
    number[often] = np.arange(len(often), dtype=np.uint32)
    event = number[event]
    order = np.argsort(doc, kind="stable")
    docs_of_block = [len(own) for own in places]
    events_of = np.bincount(doc, minlength=sum(docs_of_block))
    event, times = event[order], np.concatenate(times)[order]
    cell, cell_counts = (np.concatenate(values) for values in zip(*cells, strict=True))
    cell, cell_counts = _summed(cell, cell_counts)
    return {
        **dict(zip(("n", "context_n", "token_n"), combined[:, often], strict=True)),
        "events_of": events_of,
        "event": event,
        "event_times": times,
        "blocks": blocks,
        "docs_of_block": np.array(docs_of_block),
        "places": np.concatenate(places),
        "cells": cell,
        "cell_counts": cell_counts,
    }


def _shards(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[list[dict[str, np.ndarray]], dict[str, np.ndarray]]]:
    """The rows of each shard and the counts of its contexts; they come sorted by shard."""
    current, rows, parts = None, [], []
    for row in _unpacked(batches, {**FIELDS, **COUNTS}):
        if row["shard"] != current and rows:
            counts, parts = _by_context(parts), []
            yield rows, counts
            rows = []
        current = row["shard"]
        (parts if "context" in row else rows).append(row)
    if rows:
        counts, parts = _by_context(parts), []
        yield rows, counts


def _by_context(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The counts of the parts in order of context; empties the parts."""

    def joined(name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, COUNTS[name]), *(part.pop(name) for part in parts)])

    context = joined("context")
    order = np.argsort(context)
    rest = {name: joined(name)[order] for name in COUNTS if name != "context"}
    return {"context": context[order], **rest}


def _cuts(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each group of rows."""
    order = np.argsort(groups, kind="stable")
    first = _runs(groups[order])
    for start, stop in zip(first, [*first[1:], len(order)], strict=True):
        yield int(groups[order[start]]), order[start:stop]


def _owner(known: Statistics, context: np.ndarray) -> np.ndarray:
    return (mixed(context ^ np.uint64(MIX)) % np.uint64(known.shards)).astype(np.int32)


def _questions(known: Statistics):
    """Of each block, which contexts which shards need counts of, packed by owner of the context.

    The counts of hot tokens are known to all, and the context of a hot pair is a hot token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PrefixHash(2 * BYTES_AT_ONCE)
        for batch in batches:
            for _, texts in _blocks(batch):
                distinct, number, before = Tokens(hashes, texts).numbered()
                hot, _ = _places(known.hot, distinct)
                # Every pair once; a pair whose context is hot asks nothing.
                pair = np.sort(before * len(distinct) + number)
                before, number = np.divmod(pair[_runs(pair)], len(distinct))
                rest = ~hot[before]
                number, before = number[rest], before[rest]
                token, hot = distinct[number], hot[number]
                token[hot] = _pair_key(token[hot], distinct[before[hot]])
                shard = (mixed(token) % np.uint64(known.shards)).astype(np.int64)
                asked = np.sort(before * known.shards + shard)
                place, shard = np.divmod(asked[_runs(asked)], known.shards)
                context = distinct[place]
                for owner, own in _cuts(_owner(known, context)) if len(context) else ():
                    values = {"context": context[own], "asking": shard[own]}
                    yield _packed(owner, 0, values, QUESTIONS)

    return run


def _context_counts(known: Statistics, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of each shard with the counts of its contexts, but for those that all tasks know.

    Questions and the counts of tokens meet by context and go on to the shards, all of them packed.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def by_owner() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(column) for column in zip(*held, strict=True)]
            for owner, own in _cuts(_owner(known, columns[0])):
                values = (column[own] for column in columns)
                yield _packed(owner, -1, dict(zip(COUNTS, values, strict=True)), COUNTS)

        for batch in batches:
            token, n, n_learnt = (batch[name].to_numpy() for name in ("token", "n", "n_learnt"))
            held.append((token.view(np.uint64), n, n_learnt))
            size += len(token)
            if size >= COUNTS_AT_ONCE:
                yield from by_owner()
                held, size = [], 0
        if size:
            yield from by_owner()

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of an owner come before the questions; each is answered once per shard."""

        def answers() -> Iterator[pa.RecordBatch]:
            asked = np.unique(np.concatenate(pending))
            place, shard = np.divmod(asked, known.shards)
            for number, own in _cuts(shard):
                values = {name: values[place[own]] for name, values in held.items()}
                yield _packed(number, -1, values, COUNTS)

        owner, parts, held, pending, size = None, [], None, [], 0
        for row in _unpacked(batches, {**COUNTS, **QUESTIONS}):
            if row["shard"] != owner:
                if pending:
                    yield from answers()
                owner, parts, held, pending, size = row["shard"], [], None, [], 0
            if row["block"] < 0:
                parts.append(row)
                continue
            if held is None:
                held, parts = _by_context(parts), []
            found, place = _places(held["context"], row["context"])
            if not found.all():
                raise ValueError("a context has no count")
            pending.append(place * known.shards + row["asking"])
            size += len(place)
            if size > max(COUNTS_AT_ONCE, 2 * len(pending[0])):
                pending = [np.unique(np.concatenate(pending))]
                size = len(pending[0])
        if pending:
            yield from answers()

    layout = "shard int, block bigint, context binary, context_n binary, context_n_learnt binary"
    singles = counts.filter("context is null").select("token", "n", "n_learnt")
    asking = "shard int, block bigint, context binary, asking binary"
    questions = rows.select("text").mapInArrow(_questions(known), asking)
    met = singles.mapInArrow(stored, layout).unionByName(questions, allowMissingColumns=True)
    met = met.repartitionById(known.shards, F.col("shard")).sortWithinPartitions("shard", "block")
    return met.mapInArrow(answered, layout)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the shards add to the texts of each block, with their keys; rows come by block."""

    def found() -> pa.RecordBatch:
        keys = own["keys"]
        known, base, score = totals[:, : len(keys)]
        arrays = [keys, known.astype(np.int64), base, score]
        return pa.RecordBatch.from_arrays(
            [pa.array(values) for values in arrays], ["key", "n_known", "base", "score"]
        )

    own = None
    for row in _unpacked(batches, {**SUMS, "keys": np.int64}):
        if "keys" in row:  # comes before what the shards add
            if own is not None:
                yield found()
            own, totals = row, np.zeros((3, len(row["keys"])))
            continue
        for total, name in zip(totals, ("n_known", "base", "score"), strict=True):
            total[row["places"]] += row[name]
    if own is not None:
        yield found()


def _statistics(counts: DataFrame, tokens: int, shards: int) -> Statistics:
    """Totals and hot tokens; a bounded number of rows comes to the driver."""
    singles = counts.filter("context is null")
    totals = singles.agg(
        F.sum("n"), F.count_if(F.col("n") > 0), F.sum("n_learnt"), F.count_if(F.col("n_learnt") > 0)
    ).collect()[0]
    often = singles.filter(F.col("n_all") * HOT_SHARE >= tokens)
    hot = often.select("token", "n", "n_learnt").collect()
    pairs = counts.filter("context is not null").filter(F.col("n_all") * HOT_PAIR_SHARE >= 3 * tokens)
    pairs = np.array([tuple(row) for row in pairs.select("token", "context").collect()], np.int64)
    pairs = pairs.reshape(-1, 2).view(np.uint64)
    order = sorted((row["token"] % (1 << 64), row["n"], row["n_learnt"]) for row in hot)
    columns = [list(column) for column in zip(*order, strict=True)] or [[], [], []]
    pairs = pairs[np.isin(pairs[:, 0], np.array(columns[0], np.uint64))]
    return Statistics(
        *(value or 0 for value in totals),
        np.array(columns[0], np.uint64),
        np.array(columns[1], np.int64),
        np.array(columns[2], np.int64),
        np.sort(_pair_key(pairs[:, 0], pairs[:, 1])),
        shards,
    )


def _pair_counts(known: Statistics, rows: DataFrame) -> np.ndarray:
    """How often each hot pair occurs in training texts and in those not kept for the weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PrefixHash(2 * BYTES_AT_ONCE)
        sums = np.zeros((2, len(known.pairs)), np.int64)
        for batch in batches:
            folds = batch["fold"].to_numpy()
            for part, texts in _blocks(batch):
                found = Tokens(hashes, texts)
                hot, _ = _places(known.hot, found.token)
                pair = _pair_key(found.token[hot], found.context[hot])
                crowd, place = _places(known.pairs, pair)
                fold_of = folds[part][found.doc[hot][crowd]]
                for total, chosen in zip(sums, (fold_of != TESTED, fold_of == LEARNT), strict=True):
                    total += np.bincount(place[chosen], minlength=len(known.pairs))
        columns = [np.arange(len(known.pairs)), *sums]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "n", "n_learnt"])

    found = np.zeros((2, len(known.pairs)), np.int64)
    counted = rows.select("fold", "text").mapInArrow(count, "pair bigint, n bigint, n_learnt bigint")
    for pair, n, learnt in counted.groupBy("pair").agg(F.sum("n"), F.sum("n_learnt")).collect():
        found[:, pair] = n, learnt
    return found


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The log10 probability of every whole text under a bigram model with deleted interpolation.

    Columns: the key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-one counts) and ``score``. The model mixes the relative frequency of a token after the
    token before it, the relative frequency of the token, and a uniform one over all known tokens
    and one unknown. The weights depend on how often the token before occurs (a bucket per power of
    two) and are learnt by expectation-maximisation on the counts of one fold of the training texts,
    with frequencies from the other folds; then all training texts count. Tokens are told apart by
    64 bits.

    1. Tokens are counted over all texts (partial sums per block before the shuffle).
    2. The occurrences, packed per block of texts, meet by token. A token with a 4,000th of all
       occurrences is dealt by context too, and a pair with some 2,000th by document; their counts
       are a few thousand that all tasks have. The counts of all other contexts are brought to
       each shard that has them.
    3. Each shard is stored as its events by document, with the counts that an event's probability
       comes from, and its held-out events as a histogram. Those come together in one of fixed
       size, on which the weights are learnt.
    4. Each shard sums what its events add to each text; the sums go back packed per block, where
       those of a text are added up.

    NULL texts are empty and consist of their end alone. A NULL key belongs to the fold of an empty
    text. Rows that repeat a key are documents of their own. Without training texts all
    probabilities are uniform.
    """
    content = F.coalesce(docs[text], F.lit(""))
    number = fold(docs[key])
    rows = docs.select(
        docs[key].alias("_id"),
        F.xxhash64(docs[key], content).alias("key"),
        F.when(number == SCORED_FOLD, F.lit(TESTED))
        .when(number == WEIGHT_FOLD, F.lit(TUNED))
        .otherwise(F.lit(LEARNT))
        .alias("fold"),
        content.alias("text"),
    )
    counted = rows.select("fold", "text").mapInArrow(
        _count, "token bigint, context bigint, n_all bigint, n bigint, n_learnt bigint"
    )
    sums = [F.sum(name).alias(name) for name in ("n_all", "n", "n_learnt")]
    counts = written_once(counted.groupBy("token", "context").agg(*sums), "token-counts")
    tokens = counts.filter("context is null").agg(F.sum("n_all")).collect()[0][0] or 0
    known = _statistics(counts, tokens, max(1, -(-tokens // SHARD_TOKENS)))

    known.pair_counts = _pair_counts(known, rows) if len(known.pairs) else None

    dealt = rows.select("key", "fold", "text").mapInArrow(_deal(known), PACKED)
    dealt = dealt.unionByName(_context_counts(known, rows, counts), allowMissingColumns=True)
    # One shard a task, with some blocks' keys; hashes would put several together.
    own = F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard"))
    dealt = dealt.repartitionById(known.shards, own).sortWithinPartitions("shard")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in _shards(batches):
            number = rows[0]["shard"]
            if number >= 0:
                yield _packed(number, -1, _events(known, rows, counts), STORED)
                continue
            for row in rows:
                yield _packed(row["shard"], row["block"], {"keys": row["keys"]}, STORED)

    layout = ", ".join(f"{name} binary" for name in STORED)
    stored = dealt.mapInArrow(events, f"shard int, block bigint, {layout}")
    stored = written_once(stored, "token-events")
    shards, keys = stored.filter("shard >= 0"), stored.filter("shard < 0")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _unpacked(batches, CELLS_OF):
            arrays = [pa.array(row["cells"]), pa.array(row["cell_counts"])]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "n"])

    found = shards.select("shard", "block", *CELLS_OF).mapInArrow(cells, "cell bigint, n bigint")
    found = found.groupBy("cell").agg(F.sum("n")).collect()
    found = np.array([tuple(row) for row in found], np.int64).reshape(-1, 2)
    weights = learn_weights(found[:, 0], found[:, 1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _unpacked(batches, EVENTS):
            model, base = _log10_probabilities(known, row, weights)
            seen = (row["token_n"] > 0).astype(np.int64)
            docs = len(row["places"])
            doc = np.repeat(np.arange(docs), row["events_of"])
            totals = [
                np.bincount(doc, row["event_times"] * values[row["event"]], minlength=docs)
                for values in (seen, base, model)
            ]
            edges = np.cumsum([0, *row["docs_of_block"]])
            for block, start, stop in zip(row["blocks"], edges[:-1], edges[1:], strict=True):
                columns = (values[start:stop] for values in (row["places"], *totals))
                yield _packed(row["shard"], block, dict(zip(SUMS, columns, strict=True)), SUMS)

    # The sums go back in blocks, as the occurrences came.
    layout = "shard int, block bigint, places binary, n_known binary, base binary, score binary"
    added = shards.select("shard", "block", *EVENTS).mapInArrow(sums, layout)
    keys = keys.select("shard", "block", "keys")
    blocks = added.unionByName(keys, allowMissingColumns=True).repartition("block")
    scored = (
        blocks.sortWithinPartitions("block", "shard")
        .mapInArrow(_by_text, "key bigint, n_known bigint, base double, score double")
        .groupBy("key")
        .agg(*[F.sum(name).alias(f"_{name}") for name in ("n_known", "base", "score")])
    )
    entries = rows.select("_id", "key", "fold", (word_count(F.col("text")) + 1).alias("n_tokens"))
    # Rows alike in key and text were summed together, and each has an equal share.
    alike = entries.groupBy("key").agg(F.count("*").alias("_rows"))
    each = scored.join(alike, "key").select(
        "key",
        F.expr("_n_known div _rows").alias("n_known"),
        (F.col("_base") / F.col("_rows")).alias("base_score"),
        (F.col("_score") / F.col("_rows")).alias("score"),
    )
    return entries.join(each, "key").select(
        F.col("_id").alias(key),
        (F.col("fold") == TESTED).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
