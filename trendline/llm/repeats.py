"""Long repeated strings: suffix arrays by deep-shallow sorting."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendline.llm.hashing import MIX, PrefixHash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
GRAM = 24
SHALLOW_WORDS = 4  # of eight bytes each
SMALL_GROUP = 1 << 14
POSITIONS_AT_ONCE = 1 << 20
PLACE_BITS = np.uint64(24)

def window_runs(
    data: np.ndarray, ends: np.ndarray, length: int, gram: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of ``length`` bytes that share their anchor: first start, last start, hash.

    The anchor of a window is the leftmost of its strings of ``gram`` bytes with the
    smallest hash. It depends on the window's content alone, so equal windows
    anywhere have equal anchors. ``data`` holds texts one after another, which end
    at ``ends``; windows stay within one text.
    """
    width = length - gram + 1
    grams = PrefixHash(POSITIONS_AT_ONCE + length)
    for block in range(0, max(0, len(data) - length + 1), POSITIONS_AT_ONCE):
        part = data[block : block + POSITIONS_AT_ONCE + length - 1]
        if len(part) < length:
            break
        hashes = grams.windows(part, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes >> PLACE_BITS << PLACE_BITS) | places
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            more = width - reach
            least = np.minimum(least[:-more], least[more:])
        anchor = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        # Cut runs where the anchor or the text changes; leave out windows across two texts.
        changes = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        inner = ends[(ends > block) & (ends < block + len(anchor))] - block
        first = np.union1d(changes, inner)
        last = np.append(first[1:], len(anchor)) - 1
        text_end = ends[np.searchsorted(ends, first + block, side="right")]
        last = np.minimum(last, text_end - length - block)
        fits = last >= first
        first, last = first[fits], last[fits]
        yield first + block, last + block, hashes[anchor[first]]


# Deep-shallow sorting


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number that sorts as they do; zeros after the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    words = padded[: len(data)].astype(np.uint64)
    for step in range(1, 8):
        words = (words << np.uint64(8)) | padded[step : step + len(data)]
    return words


class SuffixArray:
    """Suffixes of an array of bytes, compared up to a depth of ``length`` bytes.

    Every suffix must have ``length`` bytes after its start.
    """

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.words = big_endian_words(data)

    def word(self, suffixes: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes at a depth; those beyond the length count as zeros."""
        found = self.words[suffixes + depth]
        beyond = depth + 8 - self.length
        if beyond > 0:
            found = found >> np.uint64(8 * beyond) << np.uint64(8 * beyond)
        return found

    def sort(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and the number of the group of equal strings each belongs to."""
        shallow, start_of = self.shallow(suffixes)
        return self.deep(shallow, start_of)

    def shallow(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Multikey quicksort by words of eight bytes, down to the shallow depth.

        A pivot splits into smaller, equal and larger; the equal ones go on with
        the next word. Small parts are sorted by the words that are left. Returns the order and,
        for each suffix, whether it starts a group that agrees to the shallow depth.
        """
        limit = min(SHALLOW_WORDS * 8, self.length)
        order: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        stack = [(suffixes, 0)]
        while stack:
            part, depth = stack.pop()
            if not len(part):
                continue
            if depth >= limit:
                order.append(part)
                starts.append(np.arange(len(part)) == 0)
            elif len(part) <= SMALL_GROUP:
                words = [self.word(part, at) for at in range(depth, limit, 8)]
                by = np.lexsort(words[::-1])
                differs = np.zeros(len(part), bool)
                differs[0] = True
                for values in words:
                    sorted_values = values[by]
                    differs[1:] |= sorted_values[1:] != sorted_values[:-1]
                order.append(part[by])
                starts.append(differs)
            else:
                words = self.word(part, depth)
                sample = words[:: max(1, len(words) // 1024)]
                pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
                smaller, larger = words < pivot, words > pivot
                stack.append((part[larger], depth))
                stack.append((part[~smaller & ~larger], depth + 8))
                stack.append((part[smaller], depth))
        if not order:
            return suffixes, np.zeros(0, bool)
        return np.concatenate(order), np.concatenate(starts)

    def deep(self, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blind tries order the groups that agree to the shallow depth.

        The tries of all groups grow together, a level at a time. A node looks at the first byte on
        which its suffixes differ and at no byte before it: the least common
        prefix with the first of them tells which. Its children are the suffixes with equal bytes
        there. A node without such a byte up to the full depth is a leaf of equal strings.
        """
        order, starts = order.copy(), starts.copy()
        place = np.arange(len(order))
        group = np.cumsum(starts) - 1
        size = np.bincount(group, minlength=1)
        active = place[size[group] > 1] if len(order) else place
        depth = np.full(len(active), min(SHALLOW_WORDS * 8, self.length))
        while len(active):
            own = order[active]
            first = np.flatnonzero(starts[active])
            members = np.diff(np.append(first, len(active)))
            head = np.repeat(own[first], members)
            shared = self._common(own, head, depth)
            branch = np.repeat(np.minimum.reduceat(shared, first), members)
            open_node = branch < self.length
            if not open_node.any():
                break
            active, own, branch = active[open_node], own[open_node], branch[open_node]
            node = np.repeat(np.arange(len(first)), members)[open_node]
            byte = self.data[own + branch]
            by = np.lexsort((byte, node))
            order[active] = own[by]
            node, byte, branch = node[by], byte[by], branch[by]
            new = np.ones(len(active), bool)
            new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
            starts[active] = new
            child = np.cumsum(new) - 1
            several = np.bincount(child)[child] > 1
            active, depth = active[several], branch[several] + 1
        return order, np.cumsum(starts) - 1

    def _common(self, own: np.ndarray, head: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The bytes that suffixes share with their heads, known to be at least ``depth``."""
        shared = np.full(len(own), self.length)
        at = depth // 8 * 8
        live = np.flatnonzero(own != head)
        while len(live):
            here = at[live]
            beyond = np.maximum(0, here + 8 - self.length).astype(np.uint64) * np.uint64(8)
            differs = self.words[own[live] + here] ^ self.words[head[live] + here]
            differs = differs >> beyond << beyond
            ended = differs != 0
            if ended.any():
                # The leading zero bytes of the difference: its length in bits, rounded down to bytes.
                values = differs[ended]
                zeros = np.zeros(len(values), np.int64)
                for step in (32, 16, 8):
                    small = values >> np.uint64(64 - step) == 0
                    zeros[small] += step // 8
                    values = np.where(small, values << np.uint64(step), values)
                shared[live[ended]] = here[ended] + zeros
            at[live] += 8
            live = live[~ended & (here + 8 < self.length)]
        return shared


def runs_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edges = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def repeated_windows(
    data: np.ndarray, offsets: np.ndarray, document: np.ndarray, start: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pieces of text, the windows that occur in them at an earlier place, as runs.

    Piece i is ``data[offsets[i]:offsets[i + 1]]``, and starts at ``start[i]`` of a document;
    documents are numbered in their order. Returns piece, first and last offset of each run.
    """
    lengths = np.diff(offsets)
    windows = lengths - length + 1
    piece = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = offsets[piece] + offset
    owner = np.zeros(len(data) + 1, np.int64)
    owner[suffixes] = np.arange(len(suffixes))
    order, group = SuffixArray(data, length).sort(suffixes)
    number = owner[order]
    where = (document[piece[number]] << 40) | (start[piece[number]] + offset[number])
    firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    earliest = np.minimum.reduceat(where, firsts) if len(firsts) else where
    repeated = np.zeros(len(piece), bool)
    repeated[number] = where != earliest[group]
    # A run ends where its piece does.
    edge = np.zeros(len(piece) + 1, bool)
    edge[np.cumsum(windows)] = True
    edge[0] = True
    a = np.flatnonzero(repeated & (edge[:-1] | ~np.concatenate(([False], repeated[:-1]))))
    b = np.flatnonzero(repeated & (edge[1:] | ~np.concatenate((repeated[1:], [False]))))
    return piece[a], offset[a], offset[b]


# The job


def unit_hashes(
    grams: PrefixHash, data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int
) -> np.ndarray:
    """A hash of the bytes from the first to past the last window of each run."""
    found = np.zeros(len(first), np.uint64)
    for block in range(0, max(1, len(data)), POSITIONS_AT_ONCE):
        chosen = np.flatnonzero((first >= block) & (first < block + POSITIONS_AT_ONCE))
        if not len(chosen):
            continue
        stop = int(last[chosen].max()) + length
        part = data[block:stop]
        found[chosen] = grams.stretches(part, first[chosen] - block, last[chosen] + length - block)
    return found


class Chunk:
    """The texts of one chunk, in the order of their keys, one after another."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(text) for text in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def runs(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(window_runs(self.data, self.ends, length, gram))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first with its keys."""
    order = np.lexsort([np.arange(len(keys[0])), *keys])
    new = np.ones(len(order), bool)
    new[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in keys], axis=0)
    found = np.zeros(len(order), bool)
    found[order[new]] = True
    return found


def united(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


CHUNK_BYTES = 16 << 20
RUN_BYTES = 8 << 20
CROWDED = 100_000
DOCS, HASHES, UNITS, SPANS = 1, 0, 0, 1
ANCHORS = "hash bigint, chunk int, n bigint"
DEALT = (
    "bucket bigint, kind int, doc_id bigint, chunk int, local int, start bigint, content binary"
)
FOUND = "chunk int, local int, first bigint, stop bigint"
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _bytes(column: pa.Array) -> list[bytes]:
    return [(text or "").encode("utf-8", "surrogatepass") for text in column.to_pylist()]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: what moves between tasks is the texts, for the most part."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        place = batch.schema.get_field_index("text")
        packed = pa.array([pack(text) for text in _bytes(batch["text"])], pa.binary())
        yield batch.set_column(place, "text", packed)


def _chunks(
    batches: Iterator[pa.RecordBatch], names: tuple[str, ...]
) -> Iterator[tuple[int, list[dict[str, list]]]]:
    """The rows of each chunk, by kind; the rows come sorted by chunk and kind."""
    current, held = None, None
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        kind = batch["kind"].to_numpy()
        changed = (np.diff(chunks) != 0) | (np.diff(kind) != 0)
        cuts = [0, *(np.flatnonzero(changed) + 1), len(chunks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if chunks[a] != current:
                if held is not None:
                    yield current, held
                current, held = int(chunks[a]), [{name: [] for name in names} for _ in range(2)]
            part = batch.slice(a, b - a)
            for name in names:
                held[int(kind[a])][name].append(part[name])
    if held is not None:
        yield current, held


def _numbers(parts: list[pa.Array]) -> np.ndarray:
    if not parts:
        return np.empty(0, np.int64)
    return np.concatenate([part.to_numpy(zero_copy_only=False) for part in parts])


def _texts(parts: list[pa.Array]) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(text) for part in parts for text in part.to_pylist()]


def _anchors(length: int, gram: int):
    """For the texts of a batch: the hash of each anchor, by chunk, and how many runs have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Chunk(_bytes(batch["text"]))
            first, _, hashes = texts.runs(length, gram)
            chunks = batch["chunk"].to_numpy()[texts.document(first)]
            order = np.lexsort((hashes, chunks))
            hashes, chunks = hashes[order], chunks[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (chunks[1:] != chunks[:-1])
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[new].view(np.int64)),
                    pa.array(chunks[new]),
                    pa.array(counts.astype(np.int64)),
                ],
                ["hash", "chunk", "n"],
            )

    return run


def _units(length: int, gram: int):
    """Per chunk: runs whose anchor occurs elsewhere, each once, and spans that repeat inside the
    chunk.
    """

    def rows(bucket, kind, ids, chunk, local, start, content) -> pa.RecordBatch:
        size = len(bucket)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket.view(np.int64)),
                pa.array(np.full(size, kind, np.int32)),
                pa.array(ids),
                pa.array(np.full(size, chunk, np.int32)),
                pa.array(local.astype(np.int32)),
                pa.array(start),
                pa.array(content, pa.binary()),
            ],
            ["bucket", "kind", "doc_id", "chunk", "local", "start", "content"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = PrefixHash(POSITIONS_AT_ONCE + 4 * length)
        names = ("doc_id", "text", "hash", "crowded")
        for number, (anchors, docs) in _chunks(batches, names):
            ids = _numbers(docs["doc_id"])
            chunk = Chunk(_texts(docs["text"]))
            first, last, hashes = chunk.runs(length, gram)
            known = _numbers(anchors["hash"]).view(np.uint64)
            crowded = np.sort(known[_numbers(anchors["crowded"]).astype(bool)])
            shared = np.isin(hashes, known)
            first, last, hashes = first[shared], last[shared], hashes[shared]
            whole = unit_hashes(grams, chunk.data, first, last, length)
            new = first_of_each(whole, last - first)
            # A run of the chunk that starts later and has the same bytes is repeated as a whole.
            again, till = united(first[~new], last[~new] + length)
            # Spans of neighbouring texts may touch; cut them where a text ends.
            inner = chunk.ends[:-1]
            cut_at = inner[np.searchsorted(again, inner, side="right") > 0]
            holder = np.searchsorted(again, cut_at, side="right") - 1
            cut_at = cut_at[(cut_at > again[holder]) & (cut_at < till[holder])]
            again, till = np.sort(np.append(again, cut_at)), np.sort(np.append(till, cut_at))
            local = chunk.document(again)
            if len(again):
                spans = np.stack([till - chunk.starts[local]], axis=1).astype("<i8")
                yield rows(
                    (again + number).astype(np.uint64) * np.uint64(MIX),
                    SPANS,
                    ids[local],
                    number,
                    local,
                    again - chunk.starts[local],
                    [value.tobytes() for value in spans],
                )
            first, last, hashes = first[new], last[new], hashes[new]
            many = np.isin(hashes, crowded)
            if many.any():
                # Windows of crowded anchors go their own ways, each distinct one once.
                size = (last - first + 1)[many]
                at = np.repeat(first[many], size) + (
                    np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                )
                window = unit_hashes(grams, chunk.data, at, at, length)
                fresh = first_of_each(window)
                # The windows seen before in this chunk repeat.
                stale = at[~fresh]
                local = chunk.document(stale)
                offset = stale - chunk.starts[local]
                yield rows(
                    window[~fresh],
                    SPANS,
                    ids[local],
                    number,
                    local,
                    offset,
                    [int(stop).to_bytes(8, "little") for stop in offset + length],
                )
                first = np.concatenate([first[~many], at[fresh]])
                last = np.concatenate([last[~many], at[fresh]])
                hashes = np.concatenate([hashes[~many], window[fresh]])
            local = chunk.document(first)
            flat = chunk.data.tobytes()
            for begin in range(0, len(first), 1 << 15):
                some = slice(begin, begin + (1 << 15))
                content = [
                    flat[a : b + length]
                    for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)
                ]
                yield rows(
                    hashes[some],
                    UNITS,
                    ids[local[some]],
                    number,
                    local[some],
                    first[some] - chunk.starts[local[some]],
                    content,
                )

    return run


def _spans(length: int):
    """Whole groups of units at a time: what of them occurs earlier. Spans pass as they are."""

    def found(chunk, local, first, stop) -> pa.RecordBatch:
        arrays = [chunk.astype(np.int32), local.astype(np.int32), first, stop]
        return pa.RecordBatch.from_arrays(
            [pa.array(values) for values in arrays], ["chunk", "local", "first", "stop"]
        )

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        units = pa.Table.from_batches(parts).combine_chunks()
        column = {
            name: units[name].to_numpy()
            for name in ("bucket", "doc_id", "chunk", "local", "start")
        }
        content = units["content"].combine_chunks()
        content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
        offsets = np.frombuffer(content.buffers()[1], np.int32)[
            content.offset : content.offset + len(content) + 1
        ].astype(np.int64)
        data = np.frombuffer(content.buffers()[2], np.uint8)
        order = np.lexsort([column[name] for name in ("start", "local", "chunk", "doc_id")])
        sizes = np.diff(offsets)
        grams = PrefixHash(1)
        whole = unit_hashes(grams, data, offsets[:-1], offsets[1:] - length, length)
        # Copies of a unit repeat as a whole; only the earliest of them goes on.
        fresh = np.zeros(len(sizes), bool)
        fresh[order] = first_of_each(whole[order], sizes[order], column["bucket"][order])
        copies = np.flatnonzero(~fresh)
        # A unit that is alone with its anchor now has nothing to compare with, but itself.
        _, group = np.unique(column["bucket"], return_inverse=True)
        several = np.bincount(group[fresh], minlength=group.max(initial=0) + 1)[group] > 1
        left = order[fresh[order] & several[order]]
        pieces = [data[offsets[i] : offsets[i + 1]] for i in left.tolist()]
        chunk, local, start = column["chunk"], column["local"], column["start"]
        first, stop, owner = [start[copies]], [(start + sizes)[copies]], [copies]
        if pieces:
            same = np.ones(len(left), bool)
            for name in ("doc_id", "chunk", "local"):
                same[1:] &= column[name][left[1:]] == column[name][left[:-1]]
            same[0] = False
            document = np.cumsum(~same)
            cuts = np.cumsum([0, *sizes[left]])
            piece, a, b = repeated_windows(
                np.concatenate(pieces), cuts, document, start[left], length
            )
            first.append(start[left[piece]] + a)
            stop.append(start[left[piece]] + b + length)
            owner.append(left[piece])
        owner = np.concatenate(owner)
        if not len(owner):
            return None
        return found(chunk[owner], local[owner], np.concatenate(first), np.concatenate(stop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            spans = batch.filter(pa.array(kinds == SPANS))
            if spans.num_rows:
                stop = np.frombuffer(b"".join(spans["content"].to_pylist()), "<i8")
                yield found(
                    spans["chunk"].to_numpy(),
                    spans["local"].to_numpy(),
                    spans["start"].to_numpy(),
                    stop,
                )
            units = batch.filter(pa.array(kinds == UNITS))
            if not units.num_rows:
                continue
            if size > RUN_BYTES:
                # The rows come sorted by bucket: what is before the last bucket held is complete.
                bucket = units["bucket"].to_numpy()
                last = held[-1]["bucket"][-1].as_py()
                more = int(np.searchsorted(bucket, last, side="right"))
                held.append(units.slice(0, more))
                units = units.slice(more)
                if units.num_rows:
                    answer = solve(held)
                    if answer is not None:
                        yield answer
                    held, size = [], 0
            if units.num_rows:
                held.append(units)
                size += units.nbytes
        if held:
            answer = solve(held)
            if answer is not None:
                yield answer

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document what is left of it. The documents of a chunk are numbered in their order."""
    names = ("doc_id", "text", "local", "first", "stop")
    for _, (spans, docs) in _chunks(batches, names):
        chunk = Chunk(_texts(docs["text"]))
        local = _numbers(spans["local"]).astype(np.int64)
        base = chunk.starts[local] + local  # one unused place between texts keeps their spans apart
        first, stop = united(
            base + _numbers(spans["first"]), base + _numbers(spans["stop"])
        )
        begins = chunk.starts + np.arange(len(chunk.starts))
        owner = np.searchsorted(begins, first, side="right") - 1
        ids = pa.concat_arrays(docs["doc_id"])
        n_spans = np.bincount(owner, minlength=len(ids))
        removed = np.bincount(owner, stop - first, minlength=len(ids)).astype(np.int64)
        first, stop = first - owner, stop - owner
        flat = chunk.data
        stays = np.ones(len(flat), bool)
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            stays[a:b] = False
        left = flat[stays].tobytes()
        ends = np.cumsum(chunk.lengths - removed)
        for begin in range(0, len(ids), 1 << 12):
            some = slice(begin, begin + (1 << 12))
            begins = ends - chunk.lengths + removed
            pieces = zip(begins[some].tolist(), ends[some].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids[some],
                    pa.array(chunk.lengths[some]),
                    pa.array(removed[some]),
                    pa.array(n_spans[some].astype(np.int64)),
                    pa.array([left[a:b] for a, b in pieces], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def drop_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Every document without the bytes covered by a string of ``length`` bytes that starts earlier.

    Columns: the key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs removed) and ``kept``,
    the bytes that stay, which may cut a character. Earlier means a smaller key, or the same
    document further left. NULL texts are empty; NULL keys come first; documents that share a key go
    by a hash of their text, and documents that agree in both one after another.

    1. Documents are dealt into chunks of some 16 MB by hash. Windows of ``length`` bytes are
       grouped into runs by their anchor, which depends on their content alone.
    2. Only anchors that occur twice can hold a repeat: their hashes are counted over all chunks.
    3. Runs with such an anchor go, with their bytes, to where all runs of the anchor meet, equal
       ones of a chunk once. There the suffixes of their windows are sorted (deep-shallow): equal
       windows come to lie side by side, and all but the earliest repeat. Anchors with over 100,000
       runs are dealt by window instead, so no group grows without bound.
    4. The repeated spans return to their chunks, where their union is cut out.
    """
    rows = docs.select(
        F.coalesce(docs[key].cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"),
        docs[text].alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    mark = F.xxhash64("text")
    rows = rows.withColumn("mark", mark).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(chunks)).cast("int")
    )
    nothing = F.lit(None)
    dealt = rows.select("chunk", F.lit(DOCS).alias("kind"), "doc_id", "mark", "text").mapInArrow(
        _pack, "chunk int, kind int, doc_id bigint, mark bigint, text binary"
    )

    anchors = rows.select("chunk", "text").mapInArrow(_anchors(length, gram), ANCHORS)
    everywhere = F.sum("n").over(Window.partitionBy("hash"))
    shared = anchors.withColumn("total", everywhere).filter("total > 1")
    returned = shared.select(
        "chunk",
        F.lit(HASHES).alias("kind"),
        nothing.cast("bigint").alias("doc_id"),
        nothing.cast("bigint").alias("mark"),
        nothing.cast("binary").alias("text"),
        "hash",
        (F.col("total") > CROWDED).alias("crowded"),
    )
    with_anchors = dealt.withColumns(
        {"hash": nothing.cast("bigint"), "crowded": nothing.cast("boolean")}
    ).unionByName(returned)
    units = (
        with_anchors.repartition("chunk")
        .sortWithinPartitions("chunk", "kind", "doc_id", "mark")
        .mapInArrow(_units(length, gram), DEALT)
    )
    spans = (
        units.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_spans(length), FOUND)
    )
    with_spans = dealt.withColumns(
        {
            "local": nothing.cast("int"),
            "first": nothing.cast("bigint"),
            "stop": nothing.cast("bigint"),
        }
    ).unionByName(spans.withColumn("kind", F.lit(HASHES)), allowMissingColumns=True)
    kept = (
        with_spans.repartition("chunk")
        .sortWithinPartitions("chunk", "kind", "doc_id", "mark")
        .mapInArrow(_kept, KEPT)
    )
    known = F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id"))
    return kept.select(known.alias(key), "n_bytes", "n_removed", "n_spans", "kept")
