"""MinHash near duplicates against comparing all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

import samples
from conftest import values
from trendline.llm import minhash


def plain(rows, percent=80, size=4):
    """Rows of (key, text) to rows of the result, with every pair of sets compared."""
    sets = []
    for _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        width = min(size, len(words))
        sets.append({tuple(words[n : n + width]) for n in range(len(words) - width + 1) if width})
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    names = {}
    for n, (key, _) in enumerate(rows):
        if key is not None:
            names[find(n)] = min(key, names.get(find(n), key))
    return sorted(
        ((key, len(sets[n]), names.get(find(n)), key == names.get(find(n)))
         for n, (key, _) in enumerate(rows)),
        key=repr,
    )


def families(seed, count=6, members=25):
    """Texts with some words changed: chains of links, near misses and copies."""
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        words = samples.prose(draw, draw.choice([6, 30, 80]), 5000).split()
        for _ in range(members):
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    draw.shuffle(rows)
    return [(key * 7 % 1009, text) for key, text in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_pairs(spark, seed):
    rows = families(seed)
    found = minhash.near_duplicates(frame(spark, rows))
    assert values(found) == plain(rows)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_PAIRED", 2)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1)
    rows = families(4)
    assert values(minhash.near_duplicates(frame(spark, rows))) == plain(rows)


def test_a_large_group_of_near_copies_is_not_paired_off(spark, monkeypatch):
    draw = random.Random(5)
    base = samples.prose(draw, 100, 5000).split()
    rows = []
    for key in range(400):
        words = list(base)
        words[draw.randrange(100)] = f"x{key}"
        rows.append((key, " ".join(words)))
    tested = []
    verified = minhash._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", counted)
    found = minhash.near_duplicates(frame(spark, rows))
    assert found.filter("component_id <> 0").isEmpty()
    assert sum(tested) < 20 * len(rows)


def test_other_thresholds(spark):
    rows = families(6, members=12)
    found = minhash.near_duplicates(frame(spark, rows), shingle_words=2, least_percent=90)
    assert values(found) == plain(rows, 90, 2)


def test_awkward_rows(spark):
    rows = [(row[0], row[1]) for row in samples.awkward_documents()]
    docs = samples.documents(spark, clashes=True)
    assert values(minhash.near_duplicates(docs)) == plain(rows)
    assert minhash.near_duplicates(samples.documents(spark, [])).isEmpty()
    numbered = [(n, *row[1:]) for n, row in enumerate(samples.awkward_documents())]
    docs = samples.documents(spark, numbered, clashes=True)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    stays = [row[0] for row in plain([row[:2] for row in numbered]) if row[3]]
    assert values(kept, "doc_id") == sorted(((key,) for key in stays), key=repr)


def test_part_keys_meet_as_often_as_they_should():
    draw = np.random.default_rng(1)
    met, farthest = 0, 0
    for _ in range(300):
        words = [b"%d" % n for n in draw.integers(0, 10**9, 1000)]
        own, other = (minhash.hashes(set(part)) for part in (words[:900], words[100:]))
        one, two = minhash.minhashes(own), minhash.minhashes(other)
        first, second = (minhash.part_keys(x).reshape(2, minhash.PARTS) for x in (one, two))
        met += (first == second).any(axis=1).all()
        bits = minhash.sketch(one) ^ minhash.sketch(two)
        farthest = max(farthest, sum(((one ^ two) & np.uint64(3)) != 0))
        told = sum(bin((b | b >> 1) & 0x5555555555555555).count("1") for b in bits.tolist())
        assert told == sum(((one ^ two) & np.uint64(3)) != 0)
    assert met >= 297 and farthest < minhash.MOST_DIFFERENT


def test_fine_sketch_against_plain_python():
    values = np.random.default_rng(2).integers(0, 2**64, 700, dtype=np.uint64)
    least = {}
    for value in values.tolist():
        bin_, rank = value % minhash.BINS, value // minhash.BINS
        least[bin_] = min(rank, least.get(bin_, rank))
    whole = sum((rank & 3) << (2 * bin_) for bin_, rank in least.items())
    told = minhash.fine_sketch(values).view(np.uint64).tolist()
    assert told == [whole >> (64 * place) & (2**64 - 1) for place in range(16)]
    assert not minhash.fine_sketch(values[:0]).any()


@pytest.mark.parametrize("size", [4, 40, 1000])
def test_fine_sketches_of_similar_sets_agree(spark, size):
    draw = np.random.default_rng(size)
    rows = []
    for number in range(300):
        values = draw.integers(0, 2**64, 4 * size, dtype=np.uint64)
        # Eight tenths of the union are shared; or, for every second pair, three tenths.
        shared = 8 * size // 10 if number % 2 == 0 else 3 * size // 10
        ends = (size + shared) // 2
        sets = values[:ends], np.concatenate([values[:shared], values[ends:size]])
        rows.append((number, *(x for part in sets for x in (len(part), minhash.fine_sketch(part).tolist()))))
    pairs = spark.createDataFrame(
        rows, "number int, size long, fine array<long>, other_size long, other_fine array<long>"
    )
    agree = pairs.filter(minhash._fine_sketches_agree(80))
    assert agree.filter("number % 2 = 0").count() == 150
    assert size < 1000 or agree.filter("number % 2 = 1").isEmpty()


@pytest.mark.parametrize("size", [20, 60, 200])
def test_fine_sketches_never_part_similar_sets_and_part_others(spark, size):
    draw = np.random.default_rng(size)
    rows = []
    for number in range(200):
        values = draw.integers(0, 2**64, 2 * size, dtype=np.uint64)
        # Exactly eight tenths of the union are shared; or, for every second pair, half of it.
        shared = size * (8 if number % 2 == 0 else 5) // 10
        ends = (size + shared) // 2
        sets = values[:ends], np.concatenate([values[:shared], values[ends:size]])
        rows.append((number, *(x for part in sets for x in (len(part), minhash.fine_sketch(part).tolist()))))
    pairs = spark.createDataFrame(
        rows, "number int, size long, fine array<long>, other_size long, other_fine array<long>"
    )
    agree = pairs.filter(minhash._fine_sketches_agree(80))
    assert agree.filter("number % 2 = 0").count() == 100
    assert agree.filter("number % 2 = 1").count() <= 10


def test_the_last_round_makes_no_pairs_that_finer_sketches_tell_apart(spark):
    rows, key = [], 0
    draw = np.random.default_rng(3)
    common = draw.integers(0, 2**64, 20, dtype=np.uint64)
    for node in range(40):
        values = np.concatenate([common, draw.integers(0, 2**64, 20, dtype=np.uint64)])
        same = (0,) * len(minhash.SKETCH)
        rows.append((key, node, node, 40, *same, minhash.fine_sketch(values).tolist(), True))
    sketches = ", ".join(f"{name} long" for name in minhash.SKETCH)
    rows = spark.createDataFrame(
        rows, f"key long, node long, root long, size long, {sketches}, fine array<long>, outside boolean"
    )
    assert minhash._all_pairs(rows, 80).isEmpty()


@pytest.mark.parametrize("size", [4, 40, 400, 4000])
def test_odd_sketches_never_part_similar_sets_and_part_others(spark, size):
    draw = np.random.default_rng(size)
    rows = []
    for number in range(120):
        values = draw.integers(0, 2**64, size, dtype=np.uint64)
        # Eight tenths of the union are shared; or, for every second pair, six tenths.
        shared = 8 * size // 10 if number % 2 == 0 else 6 * size // 10
        ends = (size + shared) // 2
        sets = values[:ends], np.concatenate([values[:shared], values[ends:]])
        if 100 * shared < 80 * size and number % 2 == 0:
            sets = sets[0], sets[0]
        rows.append((number, *(x for part in sets for x in (len(part), minhash.odd_sketch(part).tolist()))))
    pairs = spark.createDataFrame(
        rows, "number int, size long, odd array<long>, other_size long, other_odd array<long>"
    )
    agree = {row["number"] for row in pairs.filter(minhash._odd_sketches_agree(80)).collect()}
    bits = [np.array([row[2], row[4]], np.int64).view(np.uint64) for row in rows]
    counts = np.array([np.bitwise_count(one ^ other).sum() for one, other in bits])
    most = minhash.most_odd(np.array([row[1] + row[3] for row in rows]), 80)
    assert agree == set(np.flatnonzero(counts <= most).tolist())
    assert agree >= set(range(0, 120, 2))
    assert not 40 <= size <= 400 or len(agree) <= 66


def test_members_of_a_family_that_are_not_alike_enough_are_not_verified(spark, monkeypatch):
    draw = random.Random(12)
    base = samples.prose(draw, 400, 10**6).split()
    rows = []
    for key in range(70):
        words = list(base)
        for place in draw.sample(range(400), 10):
            words[place] = f"x{key}-{place}"
        rows.append((key, " ".join(words)))
    rows.append((70, rows[3][1] + " more"))
    tested = []
    verified = minhash._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", counted)
    assert values(minhash.near_duplicates(frame(spark, rows))) == plain(rows)
    assert sum(tested) < 3 * len(rows)


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_JOINED", 0)
    monkeypatch.setattr(minhash, "PAIRS_IN_PART", 50)
    monkeypatch.setattr(minhash, "ROWS_IN_PART", 7)
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 11)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1)
    rows = families(13, count=3)
    assert values(minhash.near_duplicates(frame(spark, rows))) == plain(rows)


def test_places_of_pairs_are_all_pairs_with_one_outside(monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 3)
    group = np.array([0, 0, 0, 0, 1, 2, 2, 3, 3])
    outside = np.array([1, 1, 0, 0, 0, 1, 1, 1, 0])
    found = [
        pair
        for some in minhash._places_of_pairs(group, outside)
        for pair in zip(*(places.tolist() for places in some), strict=True)
    ]
    assert sorted(found) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (5, 6), (7, 8)]


def test_a_pair_meets_in_its_first_table_alone(spark, monkeypatch):
    made = []
    all_pairs = minhash._all_pairs

    def listed(rows, percent):
        pairs = all_pairs(rows, percent)
        made.extend(tuple(sorted(row)) for row in pairs.collect())
        return pairs

    monkeypatch.setattr(minhash, "_all_pairs", listed)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    rows = families(11)
    assert values(minhash.near_duplicates(frame(spark, rows))) == plain(rows)
    assert len(made) == len(set(made)) > 100


def test_buckets_of_the_same_members_count_once(spark):
    members = {1: [1, 2, 3], 2: [3, 2, 1], 3: [1, 2], 4: [1], 5: [2, 3], 6: [2, 3]}
    rows = [(node, key) for key, nodes in members.items() for node in nodes]
    found = minhash._buckets(spark.createDataFrame(rows, "node long, key long"))
    held = {}
    for key, node, count in values(found, "key", "node", "members"):
        held.setdefault((key, count), []).append(node)
    assert held == {(1, 3): [1, 2, 3], (3, 2): [1, 2], (5, 2): [2, 3]}


def test_pairs_meet_once(spark, monkeypatch):
    met = []
    once = minhash._met_once

    def listed(*arguments):
        pairs = once(*arguments)
        met.extend((row["low"], row["high"]) for row in pairs.collect())
        return pairs

    monkeypatch.setattr(minhash, "_met_once", listed)
    rows = families(8)
    assert values(minhash.near_duplicates(frame(spark, rows))) == plain(rows)
    assert len(met) == len(set(met)) and all(low < high for low, high in met)


def test_texts_go_once_to_every_part_of_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS_IN_PART", 100)
    texts = [(n, b"a b c d e f g h i j" if n < 150 else b"x %d y z a" % n) for n in range(400)]
    frame_of_texts = spark.createDataFrame(texts, "node long, words binary")
    pairs = [(n, 0) for n in range(1, 300)] + [(n, 300) for n in range(301, 310)]
    made = spark.createDataFrame(pairs, "node long, other long")
    found = values(minhash._with_texts(made, frame_of_texts), "other", "node", "words")
    assert sorted((other, node) for other, node, _ in found if node is not None) == sorted((o, n) for n, o in pairs)
    heads = [(other, words) for other, node, words in found if node is None]
    assert sorted(heads) == [(0, texts[0][1])] * 3 + [(300, texts[300][1])]
    links = values(minhash._verified(made, frame_of_texts, 4, 80), "node", "other")
    assert sorted(links) == [(n, 0) for n in range(1, 150)]
