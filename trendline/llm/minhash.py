"""Near duplicates by MinHash with tensored banding, verified on whole shingle sets.

A table's key is a pair of part keys: one out of twelve of a first collection and one out of twelve
of a second one, each made of three minhashes. 72 minhashes so give 144 tables of six, for which 864
would be computed otherwise. Two sets of similarity 0.8 share a part in either collection, and with
that a table's bucket, in 99.9 cases of 100. A part that nobody shares makes no table.

Buckets may be as large as a group of near copies, so they are not paired off. In three rounds every
member meets a pivot of its bucket; what that links is one component from then on, and members of
one component need no comparing. Then those outside a bucket's largest component meet all others;
where they are many, the bucket is dealt again by the other tables of its members first.

Two bits of each minhash are a sketch of the set. Pairs that differ in more than 26 of the 72 go
no further: sets of similarity 0.8 do so once in a million cases. What is left meets once, whatever the
number of its tables, and is held against a finer sketch, two bits of the least hash in each of 512
bins, with the same chance of an error in large sets and none in small ones, whose difference bounds the
bins that differ. An odd sketch, the parities of the number of hashes in each of 1,024 bins, differs in at
most as many bins as there are hashes that only one of the two sets holds, so what it tells apart is never
similar. In the last round buckets bring sketches along, so that pairs they tell apart are never made:
small buckets are joined, each pair in the first table that the two have in common; in large ones arrays of
sketches are held against each other. The rest is verified on the distinct shingles of both whole texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from trendline.llm.components import components
from trendline.llm.hashing import mixed
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
LEAST_PERCENT = 80
PARTS = 12
HASHES_IN_PART = 3
BINS = 512
ODD_BINS = 1024
SKETCH = ("sketch0", "sketch1", "sketch2")
MOST_DIFFERENT = 26
MOST_DEVIATIONS = 5.5
PAIRS_OF_BITS = 0x5555555555555555
PIVOT_ROUNDS = 3
TABLE_BIT = 55  # of a bucket's key: the number of its table is above the hash
MOST_JOINED = 32
MOST_PAIRED = 1000
MEMBERS_IN_PART = 256
PAIRS_IN_PART = 1 << 26
ROWS_IN_PART = 1 << 16
PAIRS_AT_ONCE = 1 << 19
HASHES_AT_ONCE = 1 << 13
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | bytes | None, shingle_words: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct shingles of a text; fewer words than a shingle are one shingle, none are none.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    """
    data = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
    words = data.lower().split()
    width = min(shingle_words, len(words))
    return set(map(b" ".join, zip(*(words[place:] for place in range(width)), strict=False)))


def hashes(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def minhashes(values: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each function."""
    functions = 2 * PARTS * HASHES_IN_PART
    seeds = mixed(np.arange(1, functions + 1, dtype=np.uint64) * FIRST)
    least = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), HASHES_AT_ONCE):
        some = mixed(values[start : start + HASHES_AT_ONCE, None] ^ seeds)
        np.minimum(least, some.min(axis=0), out=least)
    return least


def part_keys(least: np.ndarray) -> np.ndarray:
    """The part keys of the first collection, then those of the second one."""
    parts = least.reshape(-1, HASHES_IN_PART)
    keys = np.zeros(len(parts), np.uint64)
    for column in parts.T:
        keys = mixed(keys * SECOND + column)
    return keys.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of every minhash, side by side in three numbers."""
    bits = np.zeros((32 * len(SKETCH), 2), np.uint8)
    for place in range(2):
        bits[: len(least), place] = (least >> np.uint64(place)) & np.uint64(1)
    return np.packbits(bits.ravel(), bitorder="little").view(np.int64)


def fine_sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of the least of a set's hashes in each bin, 0 in empty ones, in sixteen numbers."""
    none = np.iinfo(np.uint64).max
    least = np.full(BINS, none, np.uint64)
    np.minimum.at(least, (values % np.uint64(BINS)).astype(np.int64), values // np.uint64(BINS))
    bits = [(least >> np.uint64(place)) & np.uint64(1) & (least != none) for place in range(2)]
    return np.packbits(np.array(bits, np.uint8).T.ravel(), bitorder="little").view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Whether each bin holds an odd number of a set's hashes, in sixteen numbers."""
    bins = (values >> np.uint64(32)) % np.uint64(ODD_BINS)
    odd = np.bincount(bins.astype(np.int64), minlength=ODD_BINS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _marked(docs: DataFrame, key: str, text: str, shingle_words: int, whole: bool) -> DataFrame:
    """Every row with its number, its words, their digest, the size of its set and its part keys."""
    own = [F.struct(*[docs[name] for name in docs.columns]).alias("_doc")] if whole else []
    rows = docs.select(docs[key].alias("_id"), docs[text].alias("_text"), *own)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    kept = [name for name in rows.columns if name != "_text"]
    schema = StructType(rows.select(*kept).schema.fields)
    schema = schema.add("words", BinaryType()).add("digest", BinaryType())
    schema = schema.add("size", LongType()).add("parts", ArrayType(LongType()))
    schema = schema.add("fine", ArrayType(LongType())).add("odd", ArrayType(LongType()))
    for name in SKETCH:
        schema = schema.add(name, LongType())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            words, digests, sizes, parts, fine, odd, sketches = [], [], [], [], [], [], []
            for text in batch["_text"]:
                lowered = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                words.append(b" ".join(lowered.split()))
                found = shingles(words[-1], shingle_words)
                digests.append(sha256(words[-1]).digest())
                sizes.append(len(found))
                values = hashes(found)
                fine.append(fine_sketch(values))
                odd.append(odd_sketch(values))
                least = minhashes(values)
                parts.append(part_keys(least))
                sketches.append(sketch(least))
            columns = [
                *(batch[name] for name in kept),
                pa.array(words, pa.binary()),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(parts, pa.list_(pa.int64())),
                pa.array(fine, pa.list_(pa.int64())),
                pa.array(odd, pa.list_(pa.int64())),
                *(pa.array(column) for column in np.array(sketches, np.int64).reshape(-1, 3).T),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return written_once(rows.mapInArrow(mark, schema), "minhash-rows", "zstd")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys more than one row has."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(written_once(counts.select(*keys), "keys"), keys)


def _buckets(keyed: DataFrame) -> DataFrame:
    """``node`` and ``key`` of buckets of more than one member, with their number ``members``.

    Tables that put the same nodes together say the same, so one bucket stays of those with the same
    members, told by their number, the smallest and the largest of them and 128 bits of hashes.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"_x{seed}") for seed in range(2)]
    held = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("_low"), F.max("node").alias("_high"), *marks
    )
    same = ["members", "_low", "_high", "_x0", "_x1"]
    kept = held.filter("members > 1").groupBy(*same).agg(F.min("key").alias("key"))
    return keyed.join(written_once(kept.select("key", "members"), "keys"), "key")


def _tables(classes: DataFrame) -> DataFrame:
    """``node`` and the keys ``tables`` of all pairs of its parts that others share as well.

    Keys sort by the place of the first part, then by that of the second one.
    """
    parts = classes.select("node", F.posexplode("parts").alias("place", "part"))
    listed = F.collect_list(F.struct("place", "part")).alias("parts")
    shared = _shared(parts, ["place", "part"]).groupBy("node").agg(listed)
    first = F.filter("parts", lambda part: part["place"] < PARTS)
    second = F.filter("parts", lambda part: part["place"] >= PARTS)

    def key(a: Column, b: Column) -> Column:
        table = a["place"].cast("bigint") * F.lit(PARTS) + b["place"] - F.lit(PARTS)
        return F.shiftleft(table, TABLE_BIT).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(a, b), 64 - TABLE_BIT)
        )

    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: key(a, b))))
    return shared.select("node", keys.alias("tables")).filter(F.size("tables") > 0)


def _rooted(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The buckets with the root of each member's component."""
    if roots is None:
        return buckets.withColumn("root", F.col("node"))
    known = buckets.join(roots, "node", "left")
    return known.withColumn("root", F.coalesce("root", "node"))


def _differing(bits: Column) -> Column:
    """How many pairs of bits hold a one."""
    return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(PAIRS_OF_BITS)))


def _may_be_similar(percent: int) -> Column:
    """Different components, sizes near enough, sketches near enough, in columns and ``other_`` ones."""
    small, large = F.least("size", "other_size"), F.greatest("size", "other_size")
    counts = [_differing(F.col(name).bitwiseXOR(F.col(f"other_{name}"))) for name in SKETCH]
    near = sum(counts[1:], counts[0]) <= F.lit(MOST_DIFFERENT)
    sized = F.lit(100) * small >= F.lit(percent) * large
    return (F.col("root") != F.col("other_root")) & sized & near


def _pivot_pairs(rooted: DataFrame, number: int, percent: int) -> DataFrame:
    """Every member of a bucket of several components with the bucket's pivot."""
    own = ["node", "root", "size", *SKETCH]
    draw = F.struct(F.xxhash64(F.lit(number), "node"), *own)
    open_ones = rooted.groupBy("key").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.min(draw).alias("pivot")
    )
    pivots = [F.col(f"pivot.{name}").alias(f"other_{name}") for name in own]
    open_ones = written_once(open_ones.filter("_low <> _high").select("key", *pivots), "pivots")
    pairs = rooted.join(open_ones, "key").filter(_may_be_similar(percent))
    return pairs.select("node", F.col("other_node").alias("other"))


def _with_largest(rooted: DataFrame) -> DataFrame:
    """Members of buckets of several components: outside the largest one, are there more such than
    are joined, and are there many?"""
    held = rooted.groupBy("key", "root").agg(F.count("*").alias("_n"))
    held = held.groupBy("key").agg(
        F.max(F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_all")
    )
    rest = F.col("_all") - F.col("_most._n")
    held = held.select("key", F.col("_most.root").alias("_largest"), rest.alias("_rest"))
    held = held.withColumns({"large": F.col("_rest") > MOST_JOINED, "many": F.col("_rest") > MOST_PAIRED})
    held = written_once(held.filter("_rest > 0").drop("_rest"), "open")
    outside = (F.col("root") != F.col("_largest")).alias("outside")
    return rooted.join(held, "key").select(*rooted.columns, outside, "large", "many")


def _in_first_table() -> Column:
    """Have two members of a bucket no table in common before its own?

    Of buckets of the same members that of the first table is kept, so two nodes always meet there.
    """
    table = F.shiftright("key", TABLE_BIT)
    ends = (F.floor(table / F.lit(PARTS)), table % F.lit(PARTS) + F.lit(PARTS))
    earlier = [
        (F.lit(place) < ends[place // PARTS]) & (F.get("parts", F.lit(place)) == F.get("other_parts", F.lit(place)))
        for place in range(2 * PARTS)
    ]
    return ~reduce(Column.__or__, earlier)


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Those outside the largest component of their bucket with all of other components.

    The rows have their finer sketch, and ``parts`` if their key is that of a table.
    """
    right = rows.toDF(*(f"other_{name}" for name in rows.columns))
    once = ~F.col("other_outside") | (F.col("node") > F.col("other_node"))
    met = (F.col("key") == F.col("other_key")) & once & _may_be_similar(percent)
    if "parts" in rows.columns:
        met &= _in_first_table()
    met &= _fine_sketches_agree(percent)
    pairs = rows.filter("outside").join(right, met)
    return pairs.select("node", F.col("other_node").alias("other"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of buckets by ``key`` and ``part``.

    A bucket has a part for every ``PAIRS_IN_PART`` pairs or ``ROWS_IN_PART`` rows, mostly one. Those
    outside its largest component go to every part, all others to their ``own`` alone.
    """
    held = rows.groupBy("key").agg(F.count("*").alias("_n"), F.count_if("outside").alias("_o"))
    parts = F.ceil(F.col("_n") * F.col("_o") / F.lit(PAIRS_IN_PART))
    held = held.select("key", F.greatest(parts, F.ceil(F.col("_n") / F.lit(ROWS_IN_PART))).alias("parts"))
    rows = rows.join(written_once(held.filter("parts > 1"), "parts"), "key", "left")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), parts))
    places = F.when(F.col("outside"), F.sequence(F.lit(0).cast("bigint"), parts - 1)).otherwise(F.array("_own"))
    rows = rows.withColumn("part", F.explode(places)).withColumn("own", F.col("part") == F.col("_own"))
    return rows.drop("parts", "_own")


def _places_of_pairs(group: np.ndarray, outside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a group, one of the two outside its largest component, some at a time.

    Those outside stand first in their group.
    """
    begin = np.searchsorted(group, group)
    seen = np.cumsum(outside) - outside
    met = seen - seen[begin]
    stops = np.cumsum(met)
    at = 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(stops, stops[at] - met[at] + PAIRS_AT_ONCE)))
        some = met[at:stop]
        right = np.repeat(np.arange(at, stop), some)
        yield begin[right] + np.arange(len(right)) - np.repeat(np.cumsum(some) - some, some), right
        at = stop


def _near(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of places are of different components and may be similar by their sizes and sketches."""
    size = rows["size"]
    small, large = (least(size[left], size[right]) for least in (np.minimum, np.maximum))
    may = (rows["root"][left] != rows["root"][right]) & (100 * small >= percent * large)
    # Of two outside, that of the smaller number is in its own part.
    first = np.where(rows["node"][left] < rows["node"][right], left, right)
    may &= rows["own"][np.where(rows["outside"][right], first, right)]
    kept = np.flatnonzero(may)

    def differing(name: str, in_pairs: bool) -> np.ndarray:
        bits = rows[name][left[kept]] ^ rows[name][right[kept]]
        if in_pairs:
            bits = (bits | bits >> np.uint64(1)) & np.uint64(PAIRS_OF_BITS)
        return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    kept = kept[differing("sketch", True) <= MOST_DIFFERENT]
    kept = kept[differing("odd", False) <= most_odd(small[kept] + large[kept], percent)]
    return kept[differing("fine", True) <= most_fine(small[kept], percent)]


def most_odd(both: np.ndarray, percent: int) -> np.ndarray:
    """In how many bins odd sketches of similar sets of ``both`` hashes together differ at most.

    A hash that one set alone holds turns one bin, so there is a certain bound; where many meet in a
    bin, there is one for all but one pair in a million.
    """
    alone = both * (100 - percent) / (100 + percent)
    once, twice = (1 - 2 / ODD_BINS) ** alone, (1 - 4 / ODD_BINS) ** alone
    mean = ODD_BINS / 2 * (1 - once)
    variance = ODD_BINS / 4 * (1 - twice) + ODD_BINS**2 / 4 * (twice - once**2)
    likely = mean + MOST_DEVIATIONS * np.sqrt(np.maximum(variance, 0)) + 1
    return np.floor(np.minimum(alone + 1e-6, likely)).astype(np.int64)


def most_fine(small: np.ndarray, percent: int) -> np.ndarray:
    """In how many bins finer sketches of similar sets differ at most, see ``_fine_sketches_agree``."""
    filled = np.minimum(float(BINS), small * 100.0 / percent)
    chance = 0.75 * (1 - percent / 100)
    likely = filled * chance + np.sqrt(filled * chance * (1 - chance)) * MOST_DEVIATIONS + 2
    return np.floor(np.minimum((100 - percent) * small // percent + 1, likely)).astype(np.int64)


def _near_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``_all_pairs`` whose odd sketches agree as well, compared without being made.

    For large buckets. A pair comes as often as it meets.
    """
    lists = ["fine", "odd"]
    numbers = ["key", "part", "node", "root", "size", *SKETCH]
    dealt = _dealt(rows).select(*numbers, "outside", "own", *lists)
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", ~F.col("outside"))

    def held(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {name: batch[name].to_numpy() for name in ("key", "part", "node", "root", "size")}
        found |= {name: batch[name].to_numpy(zero_copy_only=False) for name in ("outside", "own")}
        found["sketch"] = np.stack([batch[name].to_numpy() for name in SKETCH], axis=1).view(np.uint64)
        for name in lists:
            found[name] = batch[name].flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64)
        return found

    def paired(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        changes = (np.diff(found["key"]) != 0) | (np.diff(found["part"]) != 0)
        group = np.concatenate([np.zeros(1, np.int64), np.cumsum(changes)])
        for left, right in _places_of_pairs(group, found["outside"].astype(np.int64)):
            near = _near(found, left, right, percent)
            ends = [pa.array(found["node"][place[near]]) for place in (left, right)]
            yield pa.RecordBatch.from_arrays(ends, ["node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = held(batch)
            # The last bucket of a batch may go on in the next one.
            last = (new["key"] == new["key"][-1]) & (new["part"] == new["part"][-1])
            ended = int(np.argmax(last))
            if waiting and (ended or waiting[-1]["key"][-1] != new["key"][0] or waiting[-1]["part"][-1] != new["part"][0]):
                waiting.append({name: column[:ended] for name, column in new.items()})
                yield from paired({name: np.concatenate([x[name] for x in waiting]) for name in new})
                waiting = []
            elif ended:
                yield from paired({name: column[:ended] for name, column in new.items()})
            waiting.append({name: column[ended:] for name, column in new.items()})
        if waiting:
            yield from paired({name: np.concatenate([x[name] for x in waiting]) for name in waiting[0]})

    return dealt.mapInArrow(run, "node long, other long")


def _odd_sketches_agree(percent: int) -> Column:
    """Do odd sketches differ in no more bins than those of similar sets, see ``most_odd``?"""
    counts = [
        F.bit_count(F.get("odd", F.lit(place)).bitwiseXOR(F.get("other_odd", F.lit(place))))
        for place in range(ODD_BINS // 64)
    ]
    alone = (F.col("size") + F.col("other_size")) * F.lit((100 - percent) / (100 + percent))
    once, twice = (F.pow(F.lit(1 - bits / ODD_BINS), alone) for bits in (2, 4))
    mean = F.lit(ODD_BINS / 2) * (F.lit(1.0) - once)
    variance = F.lit(ODD_BINS / 4) * (F.lit(1.0) - twice) + F.lit(ODD_BINS**2 / 4) * (twice - once * once)
    likely = mean + F.lit(MOST_DEVIATIONS) * F.sqrt(F.greatest(variance, F.lit(0.0))) + F.lit(1.0)
    return sum(counts[1:], counts[0]) <= F.least(alone + F.lit(1e-6), likely)


def _fine_sketches_agree(percent: int) -> Column:
    """Do sets that are similar enough differ in so many bins, but for one pair in a million?

    The union of two such sets, and so the bins that either fills, has a bound in the smaller one.
    So has what only one of them holds, and a bin differs only if it has some of that; one bin more
    is let through.
    """
    small = F.least("size", "other_size")
    filled = F.least(F.lit(float(BINS)), small * F.lit(100.0) / F.lit(float(percent)))
    chance = 0.75 * (1 - percent / 100)
    deviation = F.sqrt(filled * F.lit(chance * (1 - chance)))
    most = filled * F.lit(chance) + deviation * F.lit(MOST_DEVIATIONS) + F.lit(2.0)
    counts = [
        _differing(F.get("fine", F.lit(place)).bitwiseXOR(F.get("other_fine", F.lit(place))))
        for place in range(BINS // 32)
    ]
    count = sum(counts[1:], counts[0])
    certain = F.lit(percent) * (count - F.lit(1)) <= F.lit(100 - percent) * small
    return certain & (count <= most)


def _met_once(pairs: DataFrame, compared: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame:
    """Every pair that has not met before, once, and whether its sets ``may`` be similar enough.

    ``other`` is the same of the two however often they meet, mostly the pivot.
    """
    ends = [F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")]
    pairs = pairs.groupBy(*ends).agg(F.min("other").alias("other"))
    if compared is not None:
        pairs = pairs.join(compared, ["low", "high"], "left_anti")
    node = F.when(F.col("other") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    pairs = pairs.withColumn("node", node)
    sketches = texts.select("node", "size", "fine", "odd")
    others = sketches.toDF("other", "other_size", "other_fine", "other_odd")
    may = (_odd_sketches_agree(percent) & _fine_sketches_agree(percent)).alias("may")
    pairs = pairs.join(sketches, "node").join(others, "other")
    return written_once(pairs.select("low", "high", "node", "other", may), "pairs")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of pairs by ``other`` and ``salt``; that of ``other`` has no ``node``.

    ``other`` has a part for every ``MEMBERS_IN_PART`` pairs and its text goes to each of them once.
    All are looked up at once, among the texts that are in a pair.
    """
    parts = pairs.groupBy("other").agg(F.ceil(F.count("*") / F.lit(MEMBERS_IN_PART)).alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("parts")).alias("salt")
    pairs = pairs.join(parts, "other").select("other", salt, "node", F.col("node").alias("own"))
    heads = pairs.select("other", "salt").distinct()
    heads = heads.select("other", "salt", F.lit(None).cast("bigint").alias("node"), F.col("other").alias("own"))
    wanted = heads.union(pairs)
    in_pairs = written_once(wanted.select("own").distinct(), "in-pairs")
    texts = texts.select(F.col("node").alias("own"), "words").join(in_pairs, "own", "left_semi")
    return wanted.join(texts, "own").select("other", "salt", "node", "words")


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs whose shingle sets are similar enough, larger number first.

    In each part the text of ``other`` comes first.
    """
    rows = _with_texts(pairs, texts).repartition("other", "salt")
    rows = rows.sortWithinPartitions("other", "salt", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for batch in batches:
            links = []
            others, nodes = batch["other"].to_pylist(), batch["node"].to_pylist()
            for other, node, words in zip(others, nodes, batch["words"], strict=True):
                own = shingles(words.as_py(), shingle_words)
                if node is None:
                    found = own
                    continue
                both = len(own & found)
                if 100 * both >= percent * (len(own) + len(found) - both):
                    links.append((max(node, other), min(node, other)))
            larger, smaller = zip(*links, strict=True) if links else ((), ())
            columns = [pa.array(larger, pa.int64()), pa.array(smaller, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "other"])

    return written_once(rows.mapInArrow(verify, "node long, other long"), "links")


def _linked(classes: DataFrame, rows: DataFrame, shingle_words: int, percent: int):
    """``node`` and ``root`` of the classes that are linked to a smaller one, or None."""
    tables = written_once(_tables(classes), "tables")
    keyed = tables.select("node", F.explode("tables").alias("key"))
    described = classes.select("node", "size", *SKETCH)
    buckets = written_once(_buckets(keyed).join(described, "node"), "buckets")
    met = written_once(buckets.select("node").distinct(), "met")
    texts = rows.select(F.col("_row").alias("node"), "words", "size", "fine", "odd")
    texts = texts.join(met, "node", "left_semi")
    texts = written_once(texts, "texts", "zstd")
    links, roots, compared = None, None, None

    def add(pairs: DataFrame) -> None:
        nonlocal links, roots, compared
        pairs = _met_once(pairs, compared, texts, percent)
        ends = pairs.select("low", "high")
        compared = ends if compared is None else compared.union(ends)
        pairs = pairs.filter("may")
        found = _verified(pairs, texts, shingle_words, percent)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = components(links)

    for number in range(PIVOT_ROUNDS):
        add(_pivot_pairs(_rooted(buckets, roots), number, percent))
        # The two members of a bucket of two have met now.
        buckets = buckets.filter("members > 2")
    rows = written_once(_with_largest(written_once(_rooted(buckets, roots), "rooted")), "open")
    few, many = rows.filter("not many"), rows.filter("many")
    again = many.join(tables, "node").withColumn("_table", F.explode("tables"))
    again = again.filter("_table <> key").withColumn("key", F.xxhash64("key", "_table"))
    again = written_once(_shared(again.select(rows.columns), ["key"]), "dealt-again")
    sketches = texts.select("node", "fine", "odd")
    # Half of each part key will do to tell which parts two nodes share.
    halves = F.transform("parts", lambda part: F.shiftright(part, 32).cast("int")).alias("parts")
    joined = few.filter("not large").join(sketches.drop("odd"), "node").join(classes.select("node", halves), "node")
    near = few.filter("large").union(again).join(sketches, "node")
    add(_all_pairs(joined, percent).union(_near_pairs(near, percent)))
    return roots


def _named(rows: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``digest`` and ``first``, the row that names the component, of all rows with words."""
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row")
    classes = rows.filter("size > 0").groupBy("digest").agg(
        F.min("_row").alias("node"),
        F.min(order).alias("first"),
        F.first("size").alias("size"),
        *[F.first(name).alias(name) for name in ("parts", *SKETCH)],
    )
    classes = written_once(classes, "classes")
    roots = _linked(classes, rows, shingle_words, percent)
    own = classes.select("node", "digest", "first")
    rooted = _rooted(own, roots)
    names = rooted.groupBy("root").agg(F.min("first").alias("_first"))
    return rooted.join(names, "root").select("digest", F.col("_first").alias("first"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Rows are linked if their sets of shingles share ``least_percent`` of a hundred of their union
    or more; the component is named by the smallest key that links reach and keeps the rows of that
    key. Texts of the same words are one node, however many rows have them. NULL, empty and blank
    texts have no shingle and are linked with nothing, each is a component of its own. Repeated rows
    stay as they are. A NULL key names a component only if all its keys are NULL.
    """
    rows = _marked(docs, key, text, shingle_words, whole=False)
    named = _named(rows, shingle_words, least_percent)
    found = rows.select("_id", "digest", "size").join(named, "digest", "left")
    alone = F.col("size") == F.lit(0)
    component = F.when(alone, F.col("_id")).otherwise(F.col("first._id"))
    return found.select(
        F.col("_id").alias(key),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """One row of each component, that of the smallest key, with the columns of ``docs``.

    Of rows that share that key one stays, any of them; rows without a word all stay.
    """
    rows = _marked(docs, key, text, shingle_words, whole=True)
    named = _named(rows, shingle_words, least_percent)
    stays = named.select(F.col("first._row").alias("_row")).distinct()
    kept = rows.select("_row", "size", "_doc").join(stays.withColumn("_stays", F.lit(True)), "_row", "left")
    return kept.filter("_stays or size = 0").select("_doc.*")
