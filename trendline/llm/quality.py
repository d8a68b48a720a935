"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from trendline.llm.hashing import MIX, PrefixHash, mixed
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
MOST_LABELS = 50_000
SMOOTHING = 1.0
LENIENCE = 0.01
BYTES_AT_ONCE = 1 << 21
FIXED_POINT = 1 << 20  # log weights are compared in steps of one millionth

class Hasher:
    """Hashed words and word pairs of many texts at once.

    A word is a run of letters, digits and non-ASCII bytes, or a run of other signs; case counts.
    A word's hash comes from prefix sums of a polynomial over all bytes, so no word is cut out.
    """

    def __init__(self, buckets: int = BUCKETS, longest: int = BYTES_AT_ONCE):
        self.buckets = np.uint64(buckets)
        kinds = np.full(256, 2, np.uint8)
        kinds[[9, 10, 11, 12, 13, 32]] = 0
        for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
            kinds[first : last + 1] = 1
        self.kinds = kinds
        self.words = PrefixHash(longest)

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every word and word pair, and the number of the text it is in."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(text) + 1 for text in texts])
        kinds = self.kinds[data]
        starts = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
        stops = np.append(starts[1:], len(data))
        solid = kinds[starts] != 0
        starts, stops = starts[solid], stops[solid]
        word = self.words.stretches(data, starts, stops)
        text = np.searchsorted(ends, starts, side="right")
        inside = text[1:] == text[:-1]
        pair = mixed((word[:-1] * np.uint64(MIX) + word[1:])[inside])
        buckets = np.concatenate([word, pair]) % self.buckets
        return buckets.astype(np.int64), np.concatenate([text, text[1:][inside]])


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the place of the first."""
    start, size, block = 0, 0, []
    for place, text in enumerate(texts):
        block.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size >= BYTES_AT_ONCE:
            yield start, block
            start, size, block = place + 1, 0, []
    if block:
        yield start, block


def ngram_counts(docs: DataFrame, text: str, half: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``raw``, ``target0`` and ``target1``: counts over all rows and over those of
    either half of the target, whose number is in the column ``half`` (NULL: not in the target).

    Every task hands on one row per bucket; the number of buckets is fixed.
    """
    names = ["bucket", "raw", "target0", "target1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        counts = np.zeros((3, buckets), np.int64)
        for batch in batches:
            halves = np.array(batch["_half"].to_pylist(), np.int64)
            for start, block in _blocks(batch["_text"].to_pylist()):
                bucket, number = hasher.features(block)
                counts[0] += np.bincount(bucket, minlength=buckets)
                for half in range(2):
                    chosen = bucket[halves[start + number] == half]
                    counts[1 + half] += np.bincount(chosen, minlength=buckets)
        seen = np.flatnonzero(counts[0])
        arrays = [pa.array(values, pa.int64()) for values in (seen, *counts[:, seen])]
        yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(
        docs[text].alias("_text"), F.coalesce(docs[half].cast("int"), F.lit(-1)).alias("_half")
    )
    counts = rows.mapInArrow(count, ", ".join(f"{name} bigint" for name in names))
    return counts.groupBy("bucket").agg(*[F.sum(name).alias(name) for name in names[1:]])


def bucket_counts(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Raw counts and those of both halves, a row each.

    Three numbers per bucket come to the driver, however large the corpus.
    """
    found = np.zeros((3, buckets))
    for row in counts.collect():
        found[:, row["bucket"]] = row["raw"], row["target0"], row["target1"]
    return found


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log of target over raw probability of every bucket, smoothed; 512 KB for every task."""
    buckets = len(raw)
    if not target.any():
        return np.zeros(buckets)
    models = [
        np.log(counts + SMOOTHING) - np.log(counts.sum() + SMOOTHING * buckets)
        for counts in (target, raw)
    ]
    return models[0] - models[1]


def with_log_weights(docs: DataFrame, text: str, ratios: np.ndarray, out: str) -> DataFrame:
    """Adds the log importance weight of every whole text: the sum over its n-grams."""

    names = [*docs.columns, out]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(ratios))
        for batch in batches:
            weights = [
                np.bincount(number, ratios[bucket], minlength=len(block))
                for _, block in _blocks(batch[text].to_pylist())
                for bucket, number in [hasher.features(block)]
            ]
            found = np.concatenate(weights) if weights else np.empty(0)
            columns = [*batch.columns, pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(weigh, docs.select("*").schema.add(out, DoubleType()))


def gumbel(*names: Column) -> Column:
    """Gumbel noise that depends on the columns alone, so that every run draws the same."""
    uniform = (
        F.shiftrightunsigned(F.xxhash64(*names), 11).cast("double") + F.lit(0.5)
    ) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The kth largest of a column of longs, from four counts of at most 65,536 parts each."""
    if k < 1:
        return None
    name = values.columns[0]
    shifted = values.select((F.col(name) + F.lit(1 << 62)).alias("v"))
    found, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("v", shift).bitwiseAND(F.lit(0xFFFF))
        counts = shifted.groupBy(part.alias("part")).count().collect()
        for row in sorted(counts, key=lambda row: -row["part"]):
            if row["count"] >= left:
                break
            left -= row["count"]
        else:
            return None
        shifted = shifted.filter(part == row["part"])
        found |= row["part"] << shift
    return found - (1 << 62)


def threshold(scored: list[tuple[float, bool]], lenience: float = LENIENCE) -> float:
    """The weight that tells wanted from unwanted labelled documents.

    The lowest one whose balanced accuracy comes within ``lenience`` of the best, so that
    doubt speaks for a document. Without both kinds of labels everything is above it.
    """
    good = np.sort([score for score, wanted in scored if wanted])
    bad = np.sort([score for score, wanted in scored if not wanted])
    if not len(good) or not len(bad):
        return float("-inf")
    at = np.sort(np.concatenate([good, bad]))
    kept_good = 1 - np.searchsorted(good, at) / len(good)
    kept_bad = 1 - np.searchsorted(bad, at) / len(bad)
    gain = kept_good - kept_bad
    return float(at[np.flatnonzero(gain >= gain.max() - 2 * lenience)[0]])


def resample(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most_labels: int = MOST_LABELS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds ``log_weight``, ``sample_key`` and ``kept`` to every document, under ``_doc`` its
    columns.

    The target model counts the hashed words and word pairs of labelled documents of quality 1 that
    are not toxic, the raw model those of all documents. A document's log weight is the log ratio of
    both over its whole text; with Gumbel noise added, the k largest are kept. k is how many
    documents weigh at least what best tells quality 1 from quality 0 among the labelled documents,
    each of them weighed by a model of the half of the target that it is not in.

    ``most_labels`` bounds the labelled rows used for fitting (by a hash of the key). Everything
    else counts all documents. NULL texts count as
    empty and weigh 0; the noise depends on key and text, so rows that agree in both are kept or not
    together, and so are ties at the kth key. A document with several labels takes the smallest
    quality and the largest toxicity; NULL labels and NULL keys do not count. Without usable labels
    all are kept.
    """
    known = labels.filter(
        labels[key].isNotNull() & labels["quality"].isNotNull()
    ).groupBy(labels[key].alias("_key")).agg(
        F.min("quality").alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic")
    )
    share = F.pmod(F.xxhash64("_key"), F.lit(1 << 20))
    fraction = min(1.0, most_labels / max(1, known.count()))
    sample = known.filter(share < F.lit(int(fraction * (1 << 20)))).select(
        "_key",
        ((F.col("_quality") == 1) & (F.col("_toxic") == 0)).alias("_good"),
        (F.col("_quality") == 1).alias("_wanted"),
        F.pmod(F.xxhash64(F.lit(1), "_key"), F.lit(2)).alias("_half"),
    )
    entries = docs.select(
        docs[key].alias("_id"),
        F.coalesce(docs[text], F.lit("")).alias("_text"),
        F.struct(*[docs[name] for name in docs.columns]).alias("_doc"),
    )
    # At most most_labels rows of a key and three flags.
    marked = entries.join(F.broadcast(sample), entries["_id"] == sample["_key"], "left")
    half = F.when(F.col("_good"), F.col("_half")).alias("_half")
    counts = ngram_counts(marked.select("_text", half), "_text", "_half", buckets)
    raw, *halves = bucket_counts(counts, buckets)
    ratios = log_ratios(raw, halves[0] + halves[1])
    weighed = with_log_weights(entries, "_text", ratios, "log_weight").withColumn(
        "sample_key", F.col("log_weight") + gumbel(F.col("_id"), F.col("_text"))
    )
    weighed = written_once(weighed.drop("_text"), "weighed")
    # Each labelled document is scored by the model of the half that it is not in.
    labelled = marked.filter("_key is not null").select("_text", "_wanted", "_half")
    scored = []
    for number, other in enumerate(halves[::-1]):
        checks = labelled.filter(F.col("_half") == number)
        checks = with_log_weights(checks, "_text", log_ratios(raw, other), "log_weight")
        scored += [tuple(row) for row in checks.select("log_weight", "_wanted").collect()]
    at_least = threshold(scored)
    fixed = F.round(F.col("sample_key") * F.lit(FIXED_POINT)).cast(LongType())
    wanted = weighed.filter(F.col("log_weight") >= F.lit(at_least)).count()
    last = kth_largest(weighed.select(fixed.alias("v")), wanted)
    kept = F.lit(False) if last is None else fixed >= F.lit(last)
    return weighed.withColumn("kept", kept)


def keep_wanted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return resample(docs, labels, **options).filter("kept").select("_doc.*")
