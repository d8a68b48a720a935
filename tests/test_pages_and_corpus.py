"""Page rows, page assets and chat texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from trendline.plans import chat_corpus, page_tables


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def table_rows(df, width):
    return page_tables.page_rows(df, "page_id", "html", r"(?s)<tr>(.*?)</tr>", r"<td>([^<]*)</td>", width)


def test_rows_of_all_pages(spark):
    header = "<tr><td>site</td><td>value</td></tr>"
    df = pages(
        spark,
        f"<table>{header}<tr><td>a</td><td>1</td></tr></table>",
        "<p>no table</p>",
        f"<table>{header}\n<tr><td>b</td>\n</tr></table>",
        None,
    )
    assert values(table_rows(df, 2)) == [
        (0, 0, "site", "value"),
        (0, 1, "a", "1"),
        (2, 0, "site", "value"),
        (2, 1, "b", None),
    ]


def test_page_rows_need_no_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert "Exchange" not in plan_of(table_rows(df, 3))
    assets = page_tables.page_assets(df, "page_id", "html", ["a", "img"])
    assert "Exchange" not in plan_of(assets)
    assert "url" not in plan_of(assets)


def test_rows_are_as_wide_as_they_are(spark):
    df = pages(spark, "<tr><td>a</td></tr><tr><td>b</td><td>c</td><td>d</td></tr>")
    assert values(table_rows(df, None)) == [(0, 0, "a", None, None), (0, 1, "b", "c", "d")]
    with pytest.raises(Exception, match="more than 2 cells"):
        table_rows(df, 2).collect()
    assert table_rows(pages(spark, "no rows"), None).columns == ["page_id", "row_idx"]


def test_assets(spark):
    df = pages(spark, '<img src="a"><IMG><p><img\nsrc="b"><img/><a>x</a>', "<imgx>", "<a>")
    assets = page_tables.page_assets(df, "page_id", "html", ["img", "a"])
    assert values(assets) == [(0, "a", 1), (0, "img", 4), (2, "a", 1)]
    second = page_tables.page_assets(df, "page_id", "html", ["a"], only=F.col("page_id") == 2)
    assert values(second) == [(2, "a", 1)]


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_turns_out_of_order(spark):
    df = turns_of(
        spark,
        [(1, 2, "assistant", "c"), (1, 0, "system", "a"), (2, 0, "user", None), (1, 1, "user", "b")],
    )
    assert values(chat_corpus.conversation_texts(df)) == [
        (1, 3, "### system: a\n### user: b\n### assistant: c"),
        (2, 1, "### user: "),
    ]


@pytest.mark.parametrize("count", [64, 65, 150])
def test_a_conversation_is_one_text(spark, count):
    df = turns_of(spark, [(1, n, "user", str(n)) for n in range(count)]).repartition(3)
    whole = "\n".join(f"### user: {n}" for n in range(count))
    assert values(chat_corpus.conversation_texts(df)) == [(1, count, whole)]


def test_missing_roles_and_blank_turns_stay(spark):
    df = turns_of(spark, [(1, 0, None, "said"), (2, 0, "user", None), (2, 1, None, " \n")])
    assert values(chat_corpus.conversation_texts(df)) == [
        (1, 1, "### : said"),
        (2, 2, "### user: \n### :  \n"),
    ]
    assert values(chat_corpus.truncated_texts(df)) == [(1, 3, "### : said"), (2, 4, "### user: ### :")]
    assert values(chat_corpus.truncated_texts(df, render=bare)) == [(1, 1, "said"), (2, 0, "")]


def test_parts_on_demand(spark):
    df = turns_of(spark, [(1, n, "user", str(n)) for n in range(150)])
    texts = chat_corpus.conversation_texts(df, turns_per_part=64).orderBy("part").collect()
    assert [row["n_turns"] for row in texts] == [64, 64, 22]
    whole = "\n".join(row["text"] for row in texts)
    assert whole == "\n".join(f"### user: {n}" for n in range(150))


def bare(role, text):
    return F.coalesce(text, F.lit(""))


@pytest.mark.parametrize("length", [511, 512, 513])
def test_lengths_around_the_limit(spark, length):
    text = " ".join(f"w{n}" for n in range(length))
    row = chat_corpus.truncated_texts(turns_of(spark, [(1, 0, "user", text)]), render=bare).collect()[0]
    assert row["n_tokens"] == min(length, 512)
    assert row["text"].split() == text.split()[:512]


def test_truncation_equals_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(draw.choice([1, 3, 40, 700])):
            words = [f"t{draw.randrange(99)}" for _ in range(draw.choice([0, 1, 1, 30]))]
            rows.append((conv, turn, "user", "  ".join(words) if words else None))
    expected = {}
    for conv, _, _, text in rows:
        expected.setdefault(conv, []).extend((text or "").split())
    shuffled = rows[:]
    draw.shuffle(shuffled)
    df = turns_of(spark, shuffled).repartition(6)
    result = chat_corpus.truncated_texts(df, max_tokens=100, render=bare).collect()
    assert {row["conv_id"]: row["text"].split() for row in result} == {
        conv: words[:100] for conv, words in expected.items()
    }
    assert all(row["n_tokens"] == len(row["text"].split()) for row in result)


@pytest.mark.parametrize("most", [512, 2048])
def test_long_conversations_shrink_in_salted_parts(spark, sf_dir, most):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = plan_of(chat_corpus.truncated_texts(turns, most))
    last = plan.index("Exchange hashpartitioning(conv_id")
    below = plan[last + 1 :]
    assert f"<= {most})" in below
    assert "_salt" in below[below.index("Exchange hashpartitioning(conv_id") :].splitlines()[0]
    assert plan.count("Exchange") == 2


def lengths(spark, count):
    return spark.range(count).select(
        (F.col("id") * 7919 % 100003).alias("conv_id"), (F.col("id") * 31 % 512).alias("n_tokens")
    )


def test_batches_group_similar_lengths(spark):
    texts = lengths(spark, 1003)
    batches = chat_corpus.length_batches(texts).collect()
    assert len(batches) == 1003
    by_key = sorted((row["conv_id"], row["n_tokens"]) for row in texts.collect())
    expected = {}
    for start in range(0, 1003, 200):
        group = sorted(by_key[start : start + 200], key=lambda pair: (-pair[1], pair[0]))
        for place, (key, _) in enumerate(group):
            expected[key] = start // 4 + place // 4
    assert {row["conv_id"]: row["batch"] for row in batches} == expected
    assert all(row["step"] == row["batch"] // 4 for row in batches)
    sizes = [row["batch"] for row in batches]
    assert [sizes.count(n) for n in range(251)] == [4] * 250 + [3]


def test_steps_end_the_run(spark):
    texts = lengths(spark, 1003)
    batches = chat_corpus.length_batches(texts, max_steps=30).collect()
    first = sorted(row["conv_id"] for row in texts.collect())[: 30 * 16]
    assert sorted(row["conv_id"] for row in batches) == first
    assert max(row["step"] for row in batches) == 29
