"""Conversation repair against trying every repair."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import values
from trendline.llm import turns

ROWS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Cost, audit and turns of the best repair of (role, text, fault), by uniform-cost search."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, place, out = heapq.heappop(heap)
        letters = "".join(role[:1] for role, _ in out)
        if place == len(rows) and re.fullmatch("(s?(ua)+)?", letters):
            return cost, audit, list(out)
        # What has been put out matters only by its last letter.
        if not re.fullmatch("(s?(ua)*u?)?", letters) or (place, letters[-1:]) in done:
            continue
        done.add((place, letters[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", place, (*out, (role, ""))))
        if place == len(rows):
            continue
        role, text, fault = rows[place]
        heapq.heappush(heap, (cost + 3, audit + "D", place + 1, out))
        if fault in ("blank", "duplicate"):
            continue
        flaw = fault == "truncated"
        heapq.heappush(heap, (cost + flaw, audit + "K", place + 1, (*out, (role, text))))
        for other in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2 + flaw, audit + "R", place + 1, (*out, (other, text))))


def plain(rows):
    """Rows of (conv_id, turn, role, text) to a report with the digest."""
    result = []
    for key in {row[0] for row in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ")
               for k, t, r, x in rows if k == key]
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "" if body[-1:] in tuple(".!?") and body else "truncated"
            fault = "duplicate" if (role, text) in seen else fault
            faults.append(fault if body else "blank")
            seen.add((role, text))
        cost, audit, out = plain_repair([(r, x, f) for (_, r, x), f in zip(own, faults, strict=True)])
        known = [turn for turn, _, _ in own if turn is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        letters = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        counts = [faults.count(name) for name in ("blank", "duplicate", "truncated")]
        result.append((key, gaps, *counts, illegal, cost, audit, digest))
    return sorted(result, key=repr)


def conversation(draw, key, count):
    roles = ["user", "assistant", "system", "tool", "u", "a", "s", None, "User"]
    weights = [30, 30, 6, 2, 1, 1, 1, 2, 1]
    texts = ["Yes.", "No!", "open end", "why? \n", " \t\v", "", None, "é。", "A.", "B.", "C.", "D."]
    return [
        (key, draw.choice([n, n, n, n + draw.randrange(4), None]), draw.choices(roles, weights)[0],
         draw.choice([*texts, f"{draw.random()}."]))
        for n in range(count)
    ]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def report(spark, rows):
    df = frame(spark, rows)
    return turns.repair_report(df, df)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, seed):
    draw = random.Random(seed)
    rows = []
    for key in range(250):
        rows += conversation(draw, key if key else None, draw.choice([1, 2, 3, 4, 6, 9, 15]))
    assert values(report(spark, rows)) == plain(rows)


def test_long_conversations_lie_in_many_segments(spark):
    rows = conversation(random.Random(3), 5, 3000) + conversation(random.Random(4), -9, 700)
    assert values(report(spark, rows)) == plain(rows)


def test_the_search_takes_time_in_proportion(monkeypatch):
    draw = random.Random(5)
    codes = "".join(draw.choice("suaxuauauaSUAX1234") for _ in range(20_000))
    visited = []
    moves = turns._moves
    monkeypatch.setattr(turns, "_moves", lambda *node: visited.append(1) or moves(*node))
    cost, audit, fates = turns.search(codes)
    assert len(visited) < 10 * len(codes) and len(fates) == len(codes)
    assert len(audit.replace("I", "")) == len(codes)
    assert cost >= turns.suffix_bounds(codes)[0][turns.NOTHING]


def test_a_third_of_all_rows_alike(spark):
    rows = [(1, 1, "user", "again.")] * 300 + conversation(random.Random(6), 1, 20)
    rows += [(key, n, "user", "x.") for key in range(2, 40) for n in range(6)]
    assert values(report(spark, rows)) == plain(rows)
    df = frame(spark, rows)
    placed = turns._ordered(df, "conv_id", "turn", "role", "text")
    assert placed.filter("conv = 1 and text = 'again.'").count() == 1


def test_a_hot_conversation_is_spread(spark):
    rows = [(1, n, "user", f"text {n}.") for n in range(2000)]
    rows += [(key, 0, "user", "x.") for key in range(2, 1000)]
    placed = turns._ordered(frame(spark, rows), "conv_id", "turn", "role", "text")
    parts = placed.filter("conv = 1").select(F.expr("place >> 33").alias("part"))
    assert parts.groupBy("part").count().agg(F.max("count")).collect()[0][0] < 900


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "cut"), (1, 2, "user", "")]
    repaired, told = turns.repair(frame(spark, rows))
    lines = repaired.orderBy("place", "step").select("turn", "role", "text", "edit").collect()
    assert [tuple(line) for line in lines] == [
        (0, "system", "S.", "K"), (None, "user", "", "I"), (1, "assistant", "A.", "K")
    ]
    row = told.collect()[0]
    assert (row.audit, row.cost, row.blank, row.truncated) == ("KIKDD", 8, 1, 1)


def test_damage_is_counted_and_lost_conversations_stay(spark):
    rows = [(key, turn, "user", "One. Two!") for key in range(200) for turn in range(2)]
    df = frame(spark, [*rows, (None, None, None, None)])
    damaged = turns.damaged(df)
    draw = F.expr("crc32(concat(conv_id, ':', turn)) % 20")
    expected = {row[0]: row[1] for row in df.na.drop().groupBy(draw).count().collect()}
    assert damaged.filter("conv_id is not null").count() == 400 - expected[0] + expected[3]
    assert damaged.filter("text = ''").count() == expected[1]
    assert damaged.filter("text = 'One Two'").count() == expected[2]
    found = turns.repair_report(df, damaged)
    assert found.count() == 201 and found.filter("audit is null or gaps is null").isEmpty()


def test_empty_and_clashing_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert turns.repair_report(empty, empty).isEmpty()
    rows = conversation(random.Random(8), 3, 9)
    df = frame(spark, rows)
    names = "conv place copies said code fate step part parts group_key letter turns first".split()
    clashing = df.select("*", *[F.lit(0).alias(name) for name in names])
    assert values(turns.repair_report(clashing, clashing)) == plain(rows)
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert report(spark, far).collect()[0].gaps == 2**63 - 1
