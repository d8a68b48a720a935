"""Phrase collocations by vertical partitioning of word prefixes (the plan of ERA's suffix trees).

1. Texts are tokenised once and stored as blocks of word numbers, a vocabulary to each block.
2. Vertical partitioning: prefixes of one word are counted. A prefix of more occurrences than the
   memory budget of a group is extended by a word and counted again. Prefixes that occur less often
   than asked go, with all phrases below them. The others are put into groups within the budget.
3. Each group builds its own suffix subtree, cut off at the longest phrase asked for: its suffixes
   are sorted word by word, and every node's count is the total of the leaves below it.
4. Scores, containment and ranks are plain joins and windows over the counted phrases.

What all tasks are given is bounded at every size: two filters of 1 and 8 MB that tell words and
pairs which may be frequent, 65,536 group numbers, and the prefixes above the budget, of which there
are at most one per budget of words. A filter's false alarm costs a row and changes no count.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendline.llm.hashing import mixed
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: what ends a piece of text; blanks and tabs part its words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TO_LINES = bytes.maketrans(PIECE_ENDS, b"\n" * len(PIECE_ENDS))
BREAK = b"."
LONGEST = 4
LEAST = 30
MOST = 2000
BUDGET = 1 << 18
BLOCK_WORDS = 1 << 21
WORD_BITS, PAIR_BITS = 23, 26
SLOTS = 1 << 16
SALTS = 64
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = "lang string, words binary, counts binary, ids binary"
LEAVES = "grp int, lang string, words binary, size int, leaves binary"


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, with a full stop at the end of every piece."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(TO_LINES)
    return [*data.replace(b"\n", b" . ").split(), BREAK]


def _packed(lang: str, vocabulary: dict, parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts)
    shrink = pa.Codec("zstd", compression_level=1)
    width = np.uint16 if len(vocabulary) <= 1 << 16 else np.int32
    return {
        "lang": lang,
        "words": b" ".join(vocabulary),
        "counts": np.bincount(ids, minlength=len(vocabulary)).astype(np.int64).tobytes(),
        "ids": len(ids).to_bytes(8, "little")
        + shrink.compress(ids.astype(width).tobytes(), asbytes=True),
    }


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fresh():
        vocabulary = defaultdict(count().__next__)
        vocabulary[BREAK]  # number 0
        return vocabulary, []

    def flush():
        names = ("lang", "words", "counts", "ids")
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
        for lang, (vocabulary, parts) in blocks.items():
            row = _packed(lang, vocabulary, parts)
            values = [pa.array([row[name]], kind) for name, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(values, names)

    blocks, held = defaultdict(fresh), 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found = tokens(text.as_py())
            vocabulary, parts = blocks[lang.as_py()]
            parts.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            held += len(found)
            if held >= BLOCK_WORDS:
                yield from flush()
                blocks, held = defaultdict(fresh), 0
    yield from flush()


def _codes(lang: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word, other ones in each language."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * FIRST + second * SECOND)


def _vocabulary(row: dict) -> list[bytes]:
    return row["words"].split(b" ")


def _texts(row: dict, words: int) -> np.ndarray:
    """The word numbers of a block, one text after the other."""
    width = np.dtype(np.uint16 if words <= 1 << 16 else np.int32)
    length = int.from_bytes(row["ids"][:8], "little")
    raw = pa.Codec("zstd").decompress(row["ids"][8:], length * width.itemsize, asbytes=True)
    return np.frombuffer(raw, width)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for number in range(batch.num_rows):
            yield batch.slice(number, 1).to_pylist()[0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        lang, own = row["lang"], _vocabulary(row)[1:]
        counts = np.frombuffer(row["counts"], np.int64)
        texts = [word.decode("utf-8", "surrogatepass") for word in own]
        codes = _codes(lang, own).view(np.int64)
        columns = [
            pa.array([lang] * len(own), pa.string()),
            pa.array(texts, pa.string()),
            pa.array(codes),
            pa.array(counts[1:]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "code", "n"])


class Filter:
    """A set of codes as the bits of their first digits: never says no to a member."""

    def __init__(self, codes: DataFrame, bits: int):
        self.bits = bits
        place = F.shiftrightunsigned("code", 64 - bits) + 1
        parts = codes.select(place.cast("bigint").alias("place"))
        parts = parts.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
        )
        self.bytes = bytearray(1 << (bits - 3))
        for part, found in parts.collect():  # at most 2^bits bits in all
            start = (part - 1) * len(found)
            self.bytes[start : start + len(found)] = found

    def holds(self, codes: np.ndarray) -> np.ndarray:
        place = codes >> np.uint64(64 - self.bits)
        byte = np.frombuffer(self.bytes, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
        return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent_words(row: dict, frequent: Filter):
    """Words of a block that may be frequent, their codes and the texts in their numbers.

    Number 0 stands for the end of a piece and for all other words, as no frequent phrase goes
    across either.
    """
    lang, words = row["lang"], _vocabulary(row)
    codes = _codes(lang, words)
    may_be = frequent.holds(codes)
    may_be[0] = False
    number = np.cumsum(may_be) * may_be
    kept = np.flatnonzero(may_be)
    names = [b"", *(words[place] for place in kept)]
    return lang, names, np.concatenate([codes[:1], codes[kept]]), number[_texts(row, len(words))]


def _counter_of_pairs(frequent: Filter, large: np.ndarray):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, codes, texts = _frequent_words(row, frequent)
            first, second = texts[:-1], texts[1:]
            both = (first > 0) & (second > 0)
            span = np.int64(len(codes))
            pair, n = np.unique(first[both] * span + second[both], return_counts=True)
            one, two = codes[pair // span], codes[pair % span]
            columns = [
                pa.array(_pair_codes(one, two).view(np.int64)),
                pa.array(np.isin(one, large)),
                pa.array(n.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["code", "extends", "n"])

    return pairs


def _leaves(texts: np.ndarray, may_be: np.ndarray, longest: int, span: int):
    """Distinct suffixes of two words and more, cut off where they cannot go on, and their counts."""
    column = np.concatenate([texts, np.zeros(longest, texts.dtype)])
    goes_on = np.concatenate([may_be, np.zeros(longest, bool)])
    starts = np.flatnonzero(may_be)
    columns, alive = [column[starts]], np.ones(len(starts), bool)
    for depth in range(1, longest):
        alive = alive & goes_on[starts + depth - 1]
        columns.append(np.where(alive, column[starts + depth], 0))
    key = np.zeros(len(starts), np.int64)
    for values in columns:
        _, where = np.unique(key * span + values, return_inverse=True)
        key = where.astype(np.int64)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return np.stack([values[first] for values in columns], axis=1), n


def _dealer_of_leaves(
    frequent: Filter,
    pairs: Filter,
    large_words: np.ndarray,
    large_pairs: np.ndarray,
    group_of: np.ndarray,
    longest: int,
):
    slots = np.uint64(len(group_of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lang, names, codes, texts = _frequent_words(row, frequent)
            first, second = texts[:-1], texts[1:]
            may_be = np.zeros(len(texts), bool)
            both = np.flatnonzero((first > 0) & (second > 0))
            may_be[both] = pairs.holds(_pair_codes(codes[first[both]], codes[second[both]]))
            leaves, n = _leaves(texts, may_be, longest, len(codes))
            one = codes[leaves[:, 0]]
            two = _pair_codes(one, codes[leaves[:, 1]])
            whole = two
            for place in range(2, longest):
                whole = _pair_codes(whole, codes[leaves[:, place]])
            held = np.where(np.isin(one, large_words), 2, 1)
            held = np.where((held == 2) & np.isin(two, large_pairs), longest, held)
            prefix = np.where(held == 1, one, np.where(held == 2, two, whole))
            group = group_of[(prefix % slots).astype(np.int64)]
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                words, packed = packed_leaves(names, leaves[own], held[own], n[own])
                columns = [
                    pa.array(group[own[:1]], pa.int32()),
                    pa.array([lang], pa.string()),
                    pa.array([words], pa.binary()),
                    pa.array([len(own)], pa.int32()),
                    pa.array([packed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "lang", "words", "size", "leaves"])

    return deal


def packed_leaves(
    names: list[bytes], leaves: np.ndarray, held: np.ndarray, n: np.ndarray
) -> tuple[bytes, bytes]:
    """Leaves as the words they use, and their numbers, lengths of prefixes and counts.

    ``leaves`` has a row of places in ``names`` for each leaf; 0 stands where it has ended.
    """
    used = np.unique(np.append(leaves, 0))
    table = np.searchsorted(used, leaves).astype(np.int32)
    body = table.T.tobytes() + held.astype(np.int8).tobytes() + n.astype(np.int64).tobytes()
    words = b" ".join(names[word] for word in used[1:])
    return words, pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def _unpacked(size: int, longest: int, leaves: bytes):
    length = size * (4 * longest + 1 + 8)
    body = pa.Codec("zstd").decompress(leaves, length, asbytes=True)
    table = np.frombuffer(body, np.int32, size * longest).reshape(longest, size)
    held = np.frombuffer(body, np.int8, size, 4 * size * longest)
    return table, held, np.frombuffer(body, np.int64, size, size * (4 * longest + 1))


def subtree(rows: list[tuple[str, bytes, int, bytes]], longest: int, least: int) -> list[tuple]:
    """Language, phrase and count of the nodes of two words and more below a group's prefixes.

    ``rows`` are packed leaves: language, words, how many, their numbers. A node
    shorter than its prefix has further leaves in other groups and is returned at any count.
    """
    names, langs = {b"": 0}, {}
    tables, helds, totals = [], [], []
    for lang, words, size, leaves in rows:
        own = [b"", *words.split(b" ")]
        number = np.fromiter((names.setdefault(w, len(names)) for w in own), np.int32, len(own))
        table, held, n = _unpacked(size, longest, leaves)
        tongue = np.full((1, size), langs.setdefault(lang, len(langs)), np.int32)
        tables.append(np.concatenate([tongue, number[table]]))
        helds.append(held)
        totals.append(n)
    table = np.concatenate(tables, axis=1)
    order = np.lexsort(table[::-1])
    table = table[:, order]
    held, n = np.concatenate(helds)[order], np.concatenate(totals)[order]
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    words, tongues, found = list(names), list(langs), []
    for depth, column in enumerate(table):
        changed[1:] |= column[1:] != column[:-1]
        if depth < 2:
            continue
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(n, starts)
        told = (column[starts] > 0) & ((sums >= least) | (held[starts] > depth))
        for place, total in zip(starts[told].tolist(), sums[told].tolist(), strict=True):
            phrase = b" ".join(words[word] for word in table[1 : depth + 1, place].tolist())
            lang = tongues[table[0, place]]
            found.append((lang, phrase.decode("utf-8", "surrogatepass"), total))
    return found


def _builder_of_subtrees(longest: int, least: int):
    def told(rows: list[tuple]) -> pa.RecordBatch:
        found = subtree(rows, longest, least)
        columns = zip(*found, strict=True) if found else ([], [], [])
        kinds = (pa.string(), pa.string(), pa.int64())
        values = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(values, ["lang", "phrase", "f"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for row in _rows(batches):
            if row["grp"] != group and rows:
                yield told(rows)
                rows = []
            group = row["grp"]
            rows.append((row["lang"], row["words"], row["size"], row["leaves"]))
        if rows:
            yield told(rows)

    return build


def _slot_weights(prefixes: DataFrame) -> np.ndarray:
    """Occurrences by slot, the prefix's code as an unsigned number modulo the slots."""
    slot = F.col("code").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    weights = np.zeros(SLOTS, np.int64)
    for place, weight in prefixes.groupBy(slot).agg(F.sum("n")).collect():  # at most SLOTS rows
        weights[place] = weight
    return weights


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    budget: int = BUDGET,
) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``words`` and ``f`` of phrases of up to ``longest`` words that occur
    ``least`` times or more, and ``lang`` and ``n``, the words of each language.

    Overlapping occurrences count, none goes across the end of a piece. NULL texts count as
    empty, the NULL language is ``und``, repeated rows count as often as they come. Texts
    without a word and empty tables give no row.
    """
    clean = docs.select(
        F.coalesce(docs[lang], F.lit("und")).alias("lang"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    )
    blocks = written_once(clean.mapInArrow(_pack, BLOCK), "phrase-blocks")
    counted = blocks.select("lang", "words", "counts").mapInArrow(
        _count_words, "lang string, word string, code long, n long"
    )
    all_words = counted.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))
    all_words = written_once(all_words, "phrase-words")
    sizes = all_words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = all_words.filter(F.col("n") >= least)
    frequent = Filter(words, WORD_BITS)

    # Prefixes above the budget, at most one for each budget of words.
    large = [row.code for row in words.filter(F.col("n") > budget).select("code").collect()]
    large_words = np.array(large, np.int64).view(np.uint64)
    counter = _counter_of_pairs(frequent, large_words)
    pairs = blocks.mapInArrow(counter, "code long, extends boolean, n long")
    pairs = pairs.groupBy("code", "extends").agg(F.sum("n").alias("n"))
    pairs = written_once(pairs.filter(F.col("n") >= least), "phrase-pairs")
    frequent_pairs = Filter(pairs, PAIR_BITS)
    longer = pairs.filter("extends")
    large = [row.code for row in longer.filter(F.col("n") > budget).select("code").collect()]
    large_pairs = np.array(large, np.int64).view(np.uint64)

    # Light prefixes, slot by slot, put into groups of about the budget.
    weights = _slot_weights(words.filter(F.col("n") <= budget))
    weights += _slot_weights(longer.filter(F.col("n") <= budget))
    group_of = ((np.cumsum(weights) - weights) // budget).astype(np.int32)
    dealer = _dealer_of_leaves(
        frequent, frequent_pairs, large_words, large_pairs, group_of, longest
    )
    leaves = blocks.mapInArrow(dealer, LEAVES)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.repartition(max(tasks, 1), "grp").sortWithinPartitions("grp")
    nodes = dealt.mapInArrow(
        _builder_of_subtrees(longest, least), "lang string, phrase string, f long"
    )
    nodes = nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    alone = words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    found = alone.union(nodes).withColumn("words", F.size(F.split("phrase", " ")))
    return written_once(found.select("lang", "phrase", "words", "f"), "phrases"), sizes


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _scored(phrases: DataFrame, longest: int) -> DataFrame:
    """Each phrase of two words and more at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = phrases.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), cuts)
    parts = cut.withColumns(
        {
            "head": F.array_join(F.slice(words, 1, F.col("k")), " "),
            "tail": F.array_join(F.slice(words, F.col("k") + 1, longest), " "),
        }
    )
    counts = phrases.select("lang", "phrase", "f")
    heads = counts.toDF("lang", "head", "l")
    tails = counts.toDF("lang", "tail", "r")
    both = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    both = both.withColumns({name: _wide(name) for name in ("a", "l", "r")})
    score = F.expr("cast(2000000 as decimal(7,0)) * a div (l + r)").alias("score")
    lowest = F.min(F.struct(score, "k", "l", "r")).alias("least")
    cut = both.groupBy("lang", "phrase", "a").agg(lowest)
    longs = [F.col(name).cast("bigint").alias(name) for name in ("a",)]
    longs += [F.col(f"least.{name}").cast("bigint").alias(name) for name in ("l", "r", "score")]
    return cut.select("lang", "phrase", *longs)


def _covers(phrases: DataFrame) -> DataFrame:
    """The largest count ``top`` of the longer phrases around each phrase."""
    words = F.split("phrase", " ")
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.col("words") - size + 1),
                    lambda start: F.array_join(F.slice(words, start, size), " "),
                ),
            )
        )
    )
    longer = phrases.filter("words > 2").select("lang", inner.alias("phrase"), "f")
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("top"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    most: int = MOST,
    budget: int = BUDGET,
) -> DataFrame:
    """The ``most`` best phrases of two to ``longest`` words of every language.

    ``a`` is the phrase's count and ``l`` and ``r`` are those of its parts at the cut of lowest
    score floor(2000000 * a / (l + r)), of equal ones the first; ``n`` counts the language's words. A phrase goes if one
    longer phrase around it has four fifths of its count or more. Ranks go by score and count, the
    highest first, then by phrase in the order of bytes, so ties are settled and ranks are unique.
    All arithmetic is exact. See ``phrase_counts`` for NULLs, empty texts and repeated rows.
    """
    phrases, sizes = phrase_counts(docs, text, lang, longest, least, budget)
    scored = _scored(phrases, longest).join(_covers(phrases), ["lang", "phrase"], "left")
    covered = F.lit(100) * _wide("top") >= F.lit(80) * _wide("a")
    kept = scored.filter(~F.coalesce(covered, F.lit(False))).drop("top")
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: parts of it are cut down before they meet.
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best_first))
    few = salted.withColumn("_part", part).filter(F.col("_part") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))
    ranked = few.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
