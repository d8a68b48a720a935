"""Main texts of pages and repeated strings."""

from __future__ import annotations

import random

import numpy as np
import pytest

import samples
from conftest import values
from trendline.llm import html_text, repeats

PAGE = "page_id bigint, url string, html string, text string, host string, part int"


def extract(spark, rows):
    rows = [(*row, "own text", "own host", 1) for row in rows]
    return values(html_text.extract(spark.createDataFrame(rows, PAGE).repartition(3)))


def test_the_article_alone(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header>Top</header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>
    <article><h1>A &amp; B&nbsp;&#x43;</h1><p>One <b>two</b>thr<i>ee</i><br>four</p><script>var p="</p>";</script>
    <aside>Side</aside><form>Name <input></form><table><tr><td>x</td><td>y</td></tr></table>
    <!-- no <p>comment</p> --><p>&lt;p&gt; a < b</p><section id="comments"><article class="comment">Nice!</article></section>
    </article><div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""
    text = "A & B C\n\nOne twothree four\n\nx y\n\n<p> a < b"
    assert extract(spark, [(1, "http://a/b", page)]) == [(1, "http://a/b", text, len(text))]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("", []),
        ("plain  text", ["plain text"]),
        ("<p>one<p>two<article>", ["one", "two"]),
        ("<div class='ad'>buy<article><p>main</p></article>", ["main"]),
        ("<article><p>cut <b>off", ["cut off"]),
        ("<main><p>in</p><nav>no</nav></main><p>out", ["in"]),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", ["yes"]),
        ('<p>a</p><p title="x > y">b</p><p>c <unclosed a="', ["a", "b", "c"]),
        ("<script>never ends <p>x</p>", []),
        ("<article><header><h1>Head</h1></header><p>Text</article>", ["Head", "Text"]),
        ("<article>    a　b\n</article>", ["a b"]),
    ],
)
def test_markup(html, blocks):
    assert html_text.page_blocks(html)[1] == blocks


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ('<article class="post tag-share">one', ["one"]),
        ('<article class="post category-notices">one', ["one"]),
        ('<article class="hentry comments-open">one', ["one"]),
        ('<article class="promo">one<p class="promo">no</p></article>', ["one"]),
        ('<div class="article-body with-sidebar">one</div>', ["one"]),
        ('<div class="post tag-share">one</div>', ["one"]),
        ('<div itemprop="articleBody" class="widget">one</div>', ["one"]),
        ('<article class="comment">one</article>', ["one"]),
        ('<article>one</article><article class="comment">no</article>', ["one"]),
        ('<p>one<div class="cookie-notice">no</div><div id="share-buttons">no</div>', ["one"]),
        ('<p>one<div class="site-header">no</div><div class="big sidebar">no</div>', ["one"]),
    ],
)
def test_classes_rule_out_by_whole_names_and_no_article(html, blocks):
    assert html_text.page_blocks(html)[1] == blocks


def test_what_a_host_repeats_goes_where_markup_is_silent(spark):
    line = "subscribe to our very long letter of many news today"
    rows = [
        (n, f"http://h/{n}", f"<div><p>text number {n} of its own</p><p>{line} {n}</p></div>")
        for n in range(12)
    ]
    rows += [(20, "http://other/", f"<div><p>{line}</p></div>"), (21, None, None)]
    found = extract(spark, rows)
    for n in range(12):
        text = f"text number {n} of its own\n\n{n}"
        assert (n, f"http://h/{n}", text, len(text)) in found
    assert (20, "http://other/", line, len(line)) in found
    assert (21, None, "", 0) in found


def test_marked_articles_stay_whole_even_if_copied(spark):
    draw = random.Random(1)
    shared = samples.prose(draw, 80)
    rows = [(n, f"http://h/{n}", f"<article><p>{shared}</p></article>") for n in range(30)]
    rows += [(40 + n, f"http://h/{n}", f"<article><p>{shared}</p><p>{n}</p></article>") for n in range(9)]
    assert {row[2].split("\n\n")[0] for row in extract(spark, rows)} == {shared}


def test_copies_without_an_article_keep_their_text(spark):
    draw = random.Random(4)
    shared, near = samples.prose(draw, 80), samples.prose(draw, 80)
    rows = [(n, f"http://h/{n}", f"<div><p>{shared}</p></div>") for n in range(30)]
    rows += [(40 + n, f"http://i/{n}", f"<div><p>{near}</p><p>{n}</p></div>") for n in range(15)]
    found = extract(spark, rows)
    assert {text for key, _, text, _ in found if key < 40} == {shared}
    assert {text for key, _, text, _ in found if key >= 40} == {f"{near}\n\n{n}" for n in range(15)}


def test_articles_keep_the_lines_they_share(spark):
    draw = random.Random(5)
    texts = [samples.prose(draw, 40) for _ in range(20)]
    long_line = "all quantities are meant for four hungry people and a dog"
    rows = [
        (n, f"http://h/{n}", f"<article><h2>Ingredients</h2><p>{text}</p><p>{long_line}</p></article>")
        for n, text in enumerate(texts)
    ]
    found = extract(spark, rows)
    assert {text for _, _, text, _ in found} == {f"Ingredients\n\n{text}\n\n{long_line}" for text in texts}


def test_marked_pages_go_through_the_suffix_arrays_as_well(spark):
    draw = random.Random(8)
    line = "subscribe to our very long letter of many news today"
    shared = "all quantities are meant for four hungry people and a dog"
    own = [samples.prose(draw, 40, 10**6) for _ in range(16)]
    rows = [
        (n, f"http://h/{n}", f"<article><p>{own[n]}</p><p>{shared}</p></article><div>{line}</div><footer>{line} {n}</footer>")
        for n in range(10)
    ]
    rows += [(10, "http://h/10", f"<article><h1>{line}</h1><p>{own[10]}</p></article>")]
    rows += [(n, f"http://h/{n}", f"<div><p>{own[n]}</p><p>{line}</p><p>{shared}</p></div>") for n in range(11, 15)]
    rows += [(15, "http://other/", f"<div><p>{own[15]}</p><p>{line}</p></div>")]
    # Articles stay whole; what they hold is main text elsewhere, what stands beside them is not.
    texts = {n: f"{own[n]}\n\n{shared}" for n in range(15)}
    texts |= {10: f"{line}\n\n{own[10]}", 15: f"{own[15]}\n\n{line}"}
    assert {key: text for key, _, text, _ in extract(spark, rows)} == texts
    # Two silent pages alone are too few to tell.
    found = extract(spark, [row for row in rows if row[0] not in (11, 12)])
    assert {key: text for key, _, text, _ in found} == {n: text for n, text in texts.items() if n not in (11, 12)}


def test_strings_outside_a_filter_are_left_out():
    bits = np.zeros(html_text.FILTER_BITS // 8, np.uint8)
    pages = [[f"one two three four five six seven eight {n}", "short"] for n in range(5)]
    batch = html_text.pa.RecordBatch.from_pydict({"host": ["h"] * 5, "blocks": pages})
    whole = html_text.pa.Table.from_batches(html_text._window_counts(iter([batch]))).to_pylist()
    assert sorted(row["n"] for row in whole) == [1] * 5 + [5, 5]
    wanted = next(row["window"] for row in whole if row["n"] == 5)
    slot = wanted & (html_text.FILTER_BITS - 1)
    bits[slot >> 3] |= 1 << (slot & 7)
    found = html_text.pa.Table.from_batches(html_text._window_counts(iter([batch]), bits=bits)).to_pylist()
    assert found == [{"host": "h", "window": wanted, "n": 5}]


def test_the_filter_holds_every_string(spark):
    windows = np.random.default_rng(9).integers(-(2**63), 2**63, 3000).tolist() + [0, -1]
    bits = html_text._filter_of(spark.createDataFrame([(n,) for n in windows], "window bigint"))
    slots = {n & (html_text.FILTER_BITS - 1) for n in windows}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == slots


def test_what_stands_beside_the_main_text():
    html = "<nav>Home<p>Away</nav><p>a<button>Buy</button>b</p><main><p>in</p></main><script>x</script><footer>&copy; x"
    assert html_text.page_blocks(html) == (html_text.MAIN, ["in"], ["Home", "Away", "Buy", "© x", "ab"])


def test_what_a_large_host_repeats_is_counted_over_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES_AT_ONCE", 16)
    monkeypatch.setattr(html_text, "CHARACTERS_AT_ONCE", 2000)
    draw = random.Random(6)
    line = "subscribe to our very long letter of many news today"
    notice = "this section is closed for the whole of the summer"
    rows, expected = [], []
    for n in range(600):
        own = samples.prose(draw, 3000 if n < 5 else 30, 10**6)
        # A tenth of the pages shows the notice.
        last = f"<p>{notice}</p>" if n % 10 == 0 else ""
        rows.append((n, f"http://h/{n}", f"<p>{line}</p><p>{own}</p>{last}"))
        expected.append((n, own))
    rows += [(600 + n, "http://h/copy", f"<p>{line}</p><p>copy copy</p>") for n in range(3)]
    expected += [(600 + n, "copy copy") for n in range(3)]
    assert [(key, text) for key, _, text, _ in extract(spark, rows)] == sorted(expected, key=repr)


def test_hot_host_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES_AT_ONCE", 16)
    rows = [(n, "http://hot/", f"<article><p>text {n}</p></article>") for n in range(300)]
    rows += [(0, "http://hot/", "<article><p>again</p></article>")]
    assert [(key, text) for key, _, text, _ in extract(spark, rows)] == sorted(
        [(n, f"text {n}") for n in range(300)] + [(0, "again")], key=repr
    )
    assert extract(spark, []) == []


def test_windows_of_a_suffix_array_equal_brute_force():
    draw = random.Random(2)
    tokens = np.array([draw.randrange(3) for _ in range(400)])
    page = np.sort(np.array([draw.randrange(9) for _ in range(400)]))
    tokens[np.flatnonzero(np.diff(page))] = -1 - np.arange(len(np.flatnonzero(np.diff(page))))
    found = html_text.pages_of_windows(tokens, page)
    seen = {}
    for place in range(len(tokens)):
        seen.setdefault(tuple(tokens[place : place + 8]), set()).add(page[place])
    assert [len(seen[tuple(tokens[n : n + 8])]) for n in range(393)] == found[:393].tolist()


# Repeated strings


def without_repeats(rows, length):
    """Every string of the length at its first place stays, all later ones go."""
    def order(row):
        return row[0] is not None, row[0] or 0

    seen, found = set(), []
    for key, text in sorted(rows, key=order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for start in range(len(data) - length + 1):
            window = data[start : start + length]
            if window in seen:
                gone[start : start + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for n in range(len(data)) if gone[n] and (n == 0 or not gone[n - 1]))
        kept = bytes(byte for byte, mark in zip(data, gone, strict=True) if not mark)
        found.append((key, len(data), sum(gone), runs, kept))
    return sorted(found, key=repr)


def dropped(df, **options):
    rows = repeats.drop_repeats(df, **options).collect()
    return sorted(((*row[:4], bytes(row["kept"])) for row in rows), key=repr)


def distinct_keys(rows):
    """Which of two texts under one key comes first is up to their hashes: leave one."""
    seen, found = set(), []
    for row in rows:
        if row[0] not in seen:
            found.append(row)
        seen.add(row[0])
    return found


def repetitive(seed):
    draw = random.Random(seed)
    shared = [samples.prose(draw, 60) for _ in range(4)]
    rows = []
    for n in range(40):
        parts = [draw.choice(shared) if draw.random() < 0.4 else samples.prose(draw, 25) for _ in range(4)]
        rows.append((n, "é".join(parts), "en", "s", 0))
    rows += [(50, "ab" * 400, "en", "s", 0), (51, "x" * 300, "en", "s", 0), (52, "x" * 99, "en", "s", 0)]
    rows += [(53, "x" * 100, "en", "s", 0), (54, None, None, None, None), (55, "", "", "", 0)]
    return rows


@pytest.mark.parametrize(
    ("chunk_bytes", "crowded", "length", "gram"),
    [(1 << 24, 100_000, 100, 24), (3000, 100_000, 100, 24), (3000, 3, 100, 24), (2000, 2, 50, 8)],
)
def test_repeats_equal_brute_force(spark, monkeypatch, chunk_bytes, crowded, length, gram):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = repetitive(chunk_bytes + length)
    df = samples.documents(spark, rows, clashes=True)
    found = dropped(df, length=length, gram=gram, chunk_bytes=chunk_bytes)
    assert found == without_repeats([row[:2] for row in rows], length)


def test_repeats_in_awkward_documents(spark):
    rows = distinct_keys(samples.awkward_documents())
    found = dropped(samples.documents(spark, rows), chunk_bytes=50_000)
    assert found == without_repeats([row[:2] for row in rows], 100)
    assert dropped(samples.documents(spark, [])) == []


def test_repeated_rows_keep_one_of_each(spark):
    text = samples.prose(random.Random(9), 100)
    rows = [(1, text, "en", "s", 0)] * 3 + [(None, text, "en", "s", 0)] * 2
    found = dropped(samples.documents(spark, rows), chunk_bytes=100)
    size = len(text)
    assert [row[:3] for row in found] == [(1, size, size)] * 3 + [(None, size, 0), (None, size, size)]


@pytest.mark.parametrize("seed", range(12))
def test_deep_shallow_order(monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(repeats, "SMALL_GROUP", draw.choice([4, 1 << 14]))
    monkeypatch.setattr(repeats, "SHALLOW_WORDS", draw.choice([1, 2, 4]))
    length = draw.choice([5, 12, 40, 100])
    base = bytes(draw.randrange(97, 97 + draw.choice([1, 2, 26])) for _ in range(500))
    data = base + base[100:300] + bytes([97]) * 150 + base[:length]
    array = np.frombuffer(data, np.uint8)
    starts = np.arange(len(data) - length + 1)
    order, group = repeats.SuffixArray(array, length).sort(draw.choice([starts, starts[::-1].copy()]))
    strings = [data[start : start + length] for start in order]
    assert strings == sorted(strings) and len(set(order.tolist())) == len(starts)
    assert [a == b for a, b in zip(strings, strings[1:])] == (np.diff(group) == 0).tolist()
