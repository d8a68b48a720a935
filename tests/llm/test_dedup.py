"""Exact copies, near copies and components."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import samples
from conftest import plan_of, values
from trendline.llm import components, exact_dedup, simhash

UPPER_TO_LOWER = {code: code + 32 for code in range(65, 91)}


def lowered(text):
    return (text or "").translate(UPPER_TO_LOWER)


def digest(column):
    return F.sha2(exact_dedup.normalised(column), 256)


def check_exact(df):
    rows = [(row["doc_id"], row["text"]) for row in df.collect()]
    groups = defaultdict(list)
    for key, text in rows:
        groups[lowered(text)].append(key)
    found = exact_dedup.exact_classes(df, digests={"text_sha256": digest}).collect()
    assert len(found) == len(rows)
    largest = {
        text: max(keys, key=lambda key: (key is not None, key or 0)) for text, keys in groups.items()
    }
    expected = Counter(
        (key, largest[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest())
        for key, t in rows
    )
    assert Counter((r[0], r[1], r[2], r["text_sha256"]) for r in found) == expected
    kept = Counter(row["text_sha256"] for row in found if row["kept"])
    assert kept == Counter(hashlib.sha256(text.encode()).hexdigest() for text in groups)
    assert all(row["doc_id"] == row["keep_id"] for row in found if row["kept"])


def test_exact_classes(spark):
    check_exact(samples.documents(spark))
    check_exact(samples.documents(spark, clashes=True))
    check_exact(samples.documents(spark, []))


def test_same_length_and_beginning_are_not_enough(spark):
    head = "x" * 100
    rows = [(n, head + tail, "en", "s", 0) for n, tail in enumerate(("abc", "abd", "ABC", "ab"))]
    check_exact(samples.documents(spark, rows))


def test_one_row_of_each_class_stays_whole(spark):
    df = samples.documents(spark, clashes=True)
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    texts = [lowered(row["text"]) for row in left.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(row["text"]) for row in df.collect()})


def test_exact_dedup_runs_no_python(spark):
    assert "Python" not in plan_of(exact_dedup.exact_classes(samples.documents(spark)))


# SimHash


def plain_fingerprint(text):
    words = [word.encode() for word in lowered(text).replace("\x0b", " ").split(" ")]
    words = lowered(text).encode().split()
    shingles = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(fingerprints, most):
    """The smallest fingerprint that each one reaches."""
    parent = {fp: fp for fp in fingerprints}

    def find(fp):
        while parent[fp] != fp:
            fp = parent[fp]
        return fp

    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= most:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {fp: find(fp) for fp in parent}


def check_near(df):
    rows = [(row["doc_id"], plain_fingerprint(row["text"])) for row in df.collect()]
    roots = linked({fp for _, fp in rows}, 2)
    names = defaultdict(list)
    for key, fp in rows:
        names[roots[fp]].append(key)
    smallest = {root: min((k for k in keys if k is not None), default=None) for root, keys in names.items()}
    found = simhash.near_duplicates(df)
    expected = [(key, f"{fp:016x}", smallest[roots[fp]]) for key, fp in rows]
    assert values(found) == sorted(expected, key=repr)


def test_near_duplicates(spark):
    check_near(samples.documents(spark))
    check_near(samples.documents(spark, clashes=True))
    check_near(samples.documents(spark, []))


def test_near_copies_of_long_texts(spark):
    draw = random.Random(4)
    rows = []
    for n in range(40):
        words = samples.prose(draw, 900, 100_000).split()
        rows.append((2 * n, " ".join(words), "en", "s", 0))
        words[draw.randrange(900)] = "other"
        rows.append((2 * n + 1, " ".join(words), "en", "s", 0))
    df = samples.documents(spark, rows)
    check_near(df)
    left = simhash.drop_near_copies(df)
    found = {row["component_id"] for row in simhash.near_duplicates(df).collect()}
    assert {row["doc_id"] for row in left.collect()} == found
    assert left.columns == df.columns


def test_one_row_of_each_component_stays(spark):
    df = samples.documents(spark, clashes=True)
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns
    fingerprints = [plain_fingerprint(row["text"]) for row in left.collect()]
    roots = linked({plain_fingerprint(row["text"]) for row in df.collect()}, 2)
    assert len(fingerprints) == len(set(roots.values()))
    assert {roots[fp] for fp in fingerprints} == set(roots.values())


def cluster(draw, count):
    """Fingerprints near one another, some linked in chains."""
    found = {draw.getrandbits(64) for _ in range(count)}
    base = draw.getrandbits(64)
    for _ in range(count):
        fp = base
        for _ in range(draw.randrange(6)):
            fp ^= 1 << draw.randrange(64)
        found.add(fp)
    return found


@pytest.mark.parametrize("most_in_bucket", [1000, 3])
@pytest.mark.parametrize("most_bits", [1, 2, 4])
def test_pairs_equal_brute_force(spark, monkeypatch, most_in_bucket, most_bits):
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most_in_bucket)
    fps = cluster(random.Random(most_bits), 150)
    signed = {fp - (1 << 64) if fp >> 63 else fp for fp in fps}
    df = spark.createDataFrame([(fp,) for fp in signed], "fp bigint")
    mask = (1 << 64) - 1
    expected = {
        (max(a, b), min(a, b))
        for a, b in combinations(signed, 2)
        if ((a ^ b) & mask).bit_count() <= most_bits
    }
    assert {tuple(row) for row in simhash.close_pairs(df, most_bits).collect()} == expected


def test_components_of_chains_and_stars(spark):
    chain = [(n + 1, n) for n in range(50)]
    star = [(1000 + n, 900) for n in range(80)] + [(1001, 900)]
    ring = [(2001, 2000), (2002, 2001), (2002, 2000)]
    links = spark.createDataFrame(chain + star + ring, "a bigint, b bigint").repartition(4)
    roots = {**{n: 0 for n in range(1, 51)}, **{1000 + n: 900 for n in range(80)}, 2001: 2000, 2002: 2000}
    assert {row["node"]: row["root"] for row in components.components(links).collect()} == roots
    assert components.components(links.limit(0)).collect() == []
