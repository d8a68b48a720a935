"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trendline.llm.components import components
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE_WORDS = 3
MOST_BITS = 2
HASHES_AT_ONCE = 1 << 16
BLOCKS = 6
MOST_IN_BUCKET = 1000

Bits = tuple[int, ...]


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text, as a signed 64-bit number.

    Words are runs of anything but ASCII white space, A-Z in lower case; the hash is XXH64
    of each shingle, repeats included. A bit is set if it is set in over half the hashes.
    A text of fewer words than a shingle is one shingle; without a word the result is 0.
    """
    from itertools import islice, repeat

    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle_words, len(words))
    shingles = map(b" ".join, zip(*(words[place:] for place in range(width)), strict=False))
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    ones, total = np.zeros(64, np.int64), 0
    while True:
        some = np.fromiter(islice(hashes, HASHES_AT_ONCE), np.uint64)
        if not len(some):
            break
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    value = int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    whole: bool = False,
) -> DataFrame:
    """``_id`` and ``_fingerprint`` of every document, if ``whole`` also all its columns as
    ``_doc``.
    """
    own = [F.struct(*[docs[name] for name in docs.columns]).alias("_doc")] if whole else []
    rows = docs.select(docs[key].alias("_id"), docs[text].alias("_text"), *own)
    kept = [name for name in rows.columns if name != "_text"]
    schema = rows.select(*kept).schema.add("_fingerprint", LongType())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, shingle_words) for text in batch["_text"].to_pylist()]
            columns = [*(batch[name] for name in kept), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_fingerprint"])

    return rows.mapInArrow(add, schema)


def _blocks(bits: Bits, blocks: int) -> list[Bits]:
    """The bits, dealt into blocks of about equal width."""
    blocks = min(blocks, len(bits))
    ends = [len(bits) * place // blocks for place in range(blocks + 1)]
    return [bits[start:end] for start, end in zip(ends, ends[1:], strict=False)]


def _mask(bits: Bits) -> int:
    value = sum(1 << bit for bit in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _shared_bits(bits: Bits, most_bits: int) -> list[Bits]:
    """Choices of blocks, one of which any two close fingerprints agree on."""
    blocks = _blocks(bits, max(BLOCKS, most_bits + 1))
    chosen = combinations(blocks, max(0, len(blocks) - most_bits))
    return [tuple(bit for block in choice for bit in block) for choice in chosen]


def _keyed(fps: DataFrame, choices: list[Bits], out: str) -> DataFrame:
    """A row per fingerprint and choice of blocks, with the bits chosen."""
    keys = [
        F.struct(
            F.lit(number).alias(f"{out}_choice"),
            F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias(f"{out}_bits"),
        )
        for number, bits in enumerate(choices)
    ]
    return fps.select("*", F.inline(F.array(*keys)))


def _close(keyed: DataFrame, keys: list[str], most_bits: int) -> DataFrame:
    left = keyed.select(*keys, F.col("fp").alias("a"))
    right = keyed.select(*keys, F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= F.lit(most_bits)
    return left.join(right, keys).filter((F.col("a") > F.col("b")) & near).select("a", "b")


def close_pairs(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs of different fingerprints in at most ``most_bits`` different bits, the larger first.

    ``fps`` has one column ``fp`` of distinct fingerprints. The 64 bits form six blocks (more, if
    many bits may differ). Close fingerprints agree on all blocks but as many as bits may differ, so
    they meet in a bucket of at least one choice of blocks, some 43 bits each for two bits; each
    bucket is joined with itself and the distance verified. A bucket of over 1,000 fingerprints is
    dealt again by the same rule on the bits it leaves open, which leaves at most 2^7 different ones
    in a bucket. So no bucket grows with the data, and no pair is lost.
    """
    whole = tuple(range(64))
    choices = _shared_bits(whole, most_bits)
    first = ["k_choice", "k_bits"]
    keyed = _keyed(fps, choices, "k")
    full = keyed.groupBy(*first).agg(F.count("*").alias("_n")).filter(f"_n > {MOST_IN_BUCKET}")
    full = written_once(full.select(*first), "full-buckets")
    pairs = _close(keyed.join(full, first, "left_anti"), first, most_bits)
    if full.isEmpty():
        return pairs.distinct()
    crowded = written_once(keyed.join(full, first, "left_semi"), "crowded")
    for number, bits in enumerate(choices):
        rest = tuple(bit for bit in whole if bit not in bits)
        dealt = crowded.filter(F.col("k_choice") == number).select("fp", *first)
        again = _keyed(dealt, _shared_bits(rest, most_bits), "m")
        pairs = pairs.union(_close(again, [*first, "m_choice", "m_bits"], most_bits))
    return pairs.distinct()


def _named(rows: DataFrame, most_bits: int, smallest: Column) -> DataFrame:
    """``_fingerprint`` and the ``_smallest`` value in its component, for all fingerprints."""
    known = rows.groupBy(F.col("_fingerprint").alias("fp")).agg(F.min(smallest).alias("_least"))
    known = written_once(known, "known")
    linked = components(close_pairs(known.select("fp"), most_bits))
    linked = linked.withColumnRenamed("node", "fp")
    rooted = known.join(linked, "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    names = rooted.groupBy("_root").agg(F.min("_least").alias("_smallest"))
    return rooted.join(names, "_root").select(F.col("fp").alias("_fingerprint"), "_smallest")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Key, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``most_bits`` bits;
    the component is the smallest key that a chain of links reaches. Only distinct
    fingerprints are compared, so a group of copies is one node however large it is.
    NULL texts count as empty, and texts without a word share the fingerprint 0. Repeated rows
    stay as they are. NULL keys do not name a component unless all its keys are NULL.
    """
    rows = written_once(fingerprints(docs, key, text, shingle_words), "fingerprints")
    named = _named(rows, most_bits, F.col("_id"))
    return rows.join(named, "_fingerprint").select(
        F.col("_id").alias(key),
        hexadecimal(F.col("_fingerprint")).alias("fingerprint"),
        F.col("_smallest").alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row of each component, that of the smallest key, with the columns of ``docs``.

    Of rows that share that key one stays, any of them.
    """
    rows = fingerprints(docs, key, text, shingle_words, whole=True)
    rows = written_once(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row")
    stays = _named(rows, most_bits, order).select(F.col("_smallest._row").alias("_row")).distinct()
    return rows.join(stays, "_row", "left_semi").select("_doc.*")


def hexadecimal(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))
