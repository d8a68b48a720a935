"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import samples
from conftest import values
from trendline.llm import phrases


def plain(rows, longest=4, least=3, most=2000):
    """Rows of (text, lang) to rows of the result, by counting every phrase."""
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                for place in range(len(words) - size + 1):
                    counts[lang, tuple(words[place : place + size])] += 1
    counts = {key: n for key, n in counts.items() if n >= least}
    top = Counter()
    for (lang, words), n in counts.items():
        for size in range(2, len(words)):
            for place in range(len(words) - size + 1):
                inner = (lang, words[place : place + size])
                top[inner] = max(top[inner], n)
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or 100 * top[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        row = (-score, -a, " ".join(words).encode("utf-8", "surrogatepass"), left, right)
        found.setdefault(lang, []).append(row)
    result = []
    for lang, ranked in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:most], 1):
            row = (lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score)
            result.append(row)
    return sorted(result, key=repr)


def texts(seed: int, count: int = 80):
    draw = random.Random(seed)
    ends = [" ", " ", " ", " ", "\t", ". ", ", ", "\n", "\x0b", " \x01", " ", "  "]
    rows = []
    for number in range(count):
        words = [f"W{int(draw.random() ** 3 * 12)}" for _ in range(draw.choice([0, 1, 3, 40, 90]))]
        text = "".join(word + draw.choice(ends) for word in words)
        if number % 3 == 0:
            text += " one common Passage of Words here, then é Ü. "
        rows.append((text, draw.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), (" \t\n", "xx"), ("a" * 70_000, None), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("budget", [1 << 18, 40, 3])
def test_equals_plain_counting(spark, seed, budget):
    rows = texts(seed)
    found = phrases.collocations(frame(spark, rows), least=3, budget=budget)
    assert values(found) == plain(rows)


@pytest.mark.parametrize("longest", [2, 3])
def test_other_lengths_and_limits(spark, longest):
    rows = texts(3)
    found = phrases.collocations(frame(spark, rows), longest=longest, least=4, most=5, budget=30)
    assert values(found) == plain(rows, longest, 4, 5)


def test_blocks_may_end_anywhere(spark, monkeypatch):
    rows = texts(4)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    assert values(phrases.collocations(frame(spark, rows), least=3)) == plain(rows)


def test_prefixes_above_the_budget_are_extended_and_groups_are_many(spark, monkeypatch):
    seen = []
    dealer = phrases._dealer_of_leaves

    def watched(frequent, pairs, large_words, large_pairs, group_of, longest):
        seen.append((len(large_words), len(large_pairs), len(set(group_of.tolist()))))
        return dealer(frequent, pairs, large_words, large_pairs, group_of, longest)

    monkeypatch.setattr(phrases, "_dealer_of_leaves", watched)
    rows = texts(5)
    found = phrases.collocations(frame(spark, rows), least=3, budget=30)
    assert values(found) == plain(rows)
    words, pairs, groups = seen[0]
    assert words > 3 and pairs > 0 and groups > 5


def test_a_group_reads_counts_from_its_leaves():
    names = [b"", *b"a b c d e".split()]

    def packed(lang, leaves, counts):
        table, counts = np.array(leaves), np.array(counts)
        words, body = phrases.packed_leaves(names, table, np.ones(len(counts)), counts)
        return lang, words, len(counts), body

    rows = [
        packed("en", [[1, 2, 3, 4], [1, 2, 0, 0]], [2, 3]),
        packed("en", [[1, 2, 3, 5]], [4]),
        packed("de", [[1, 2, 0, 0]], [9]),
    ]
    assert sorted(phrases.subtree(rows, longest=4, least=3)) == [
        ("de", "a b", 9), ("en", "a b", 9), ("en", "a b c", 6), ("en", "a b c e", 4)
    ]


def test_empty_and_clashing_tables(spark):
    docs = samples.documents(spark, clashes=True)
    rows = [(row.text, row.lang) for row in docs.select("text", "lang").collect()]
    assert values(phrases.collocations(docs, least=3)) == plain(rows)
    assert phrases.collocations(samples.documents(spark, [])).isEmpty()
    empty = docs.select(F.lit(None).cast("string").alias("text"), "lang")
    assert phrases.collocations(empty).isEmpty()
