"""Quality resampling, language-model scores, BPE and chat formatting."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import samples
from conftest import values
from trendline.llm import bpe, chat, language_model, quality

# Quality

LABELS = "doc_id bigint, quality int, toxic int"


def judged(spark, count=600):
    draw = random.Random(8)
    rows, labels = [], []
    for n in range(count):
        text = samples.prose(draw, draw.choice([20, 80, 200]))
        good = draw.random() < 0.75
        if not good:
            text = " ".join(word.upper() + draw.choice(["!!", "$$$"]) for word in text.split())
        rows.append((n, text, "en", "s", 0))
        if n % 2:
            labels.append((n, int(good), 0))
    return rows, labels


def test_wanted_documents_stay_and_others_go(spark):
    rows, labels = judged(spark)
    docs = samples.documents(spark, rows, clashes=True)
    found = quality.resample(docs, spark.createDataFrame(labels, LABELS))
    kept = {row[0]: row[1] for row in found.select("_doc.doc_id", "kept").collect()}
    good = {row[0]: "!!" not in row[1] and "$$$" not in row[1] for row in rows}
    assert sum(kept[n] for n in good if good[n]) >= 0.98 * sum(good.values())
    assert sum(kept[n] for n in good if not good[n]) <= 0.03 * sum(not g for g in good.values())
    wanted = quality.keep_wanted(docs, spark.createDataFrame(labels, LABELS))
    assert wanted.columns == docs.columns
    assert {row["doc_id"] for row in wanted.collect()} == {n for n in kept if kept[n]}


def test_top_k_of_perturbed_weights(spark):
    rows, labels = judged(spark, 300)
    found = quality.resample(samples.documents(spark, rows), spark.createDataFrame(labels, LABELS))
    keys = [(row["sample_key"], row["kept"]) for row in found.collect()]
    kept = [key for key, stays in keys if stays]
    assert min(kept) > max(key for key, stays in keys if not stays)
    again = quality.resample(samples.documents(spark, rows[::-1]), spark.createDataFrame(labels, LABELS))
    columns = ("_doc.doc_id", "sample_key", "kept")
    assert values(found, *columns) == values(again, *columns)


def test_weights_are_log_ratios_of_counts():
    draw = random.Random(3)
    texts = [samples.prose(draw, 30).replace("w1", "!W1 ") for _ in range(8)] + ["", "É é", "a"]
    import re

    def ngrams(text):
        words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\s\u0080-\U0010ffff]+", text)
        return [*words, *zip(words, words[1:], strict=False)]

    buckets, number = quality.Hasher(1 << 30).features([text.encode() for text in texts])
    for place, text in enumerate(texts):
        counts = Counter(ngrams(text)).values()
        own = np.unique(buckets[number == place], return_counts=True)[1]
        assert sorted(counts) == sorted(own.tolist())
    of_gram = defaultdict(set)
    for place, text in enumerate(texts):
        for bucket in set(buckets[number == place].tolist()):
            of_gram[bucket].add(place)
    by_place = Counter(frozenset(places) for places in of_gram.values())
    plain = defaultdict(set)
    for place, text in enumerate(texts):
        for gram in ngrams(text):
            plain[gram].add(place)
    assert by_place == Counter(frozenset(places) for places in plain.values())


def plain_resample(spark, rows, labels):
    """Log weights, keys and decisions of the documents, worked out one by one."""
    noise_of = spark.createDataFrame([row[:2] for row in rows], "id bigint, text string")
    noise = {row[0]: row[1] for row in noise_of.select("id", quality.gumbel(F.col("id"), F.col("text"))).collect()}
    halves = spark.createDataFrame([label[:1] for label in labels], "id bigint")
    halves = dict(halves.select("id", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2))).collect())
    grams = {key: quality.Hasher().features([text.encode()])[0].tolist() for key, text, *_ in rows}
    raw = Counter(gram for found in grams.values() for gram in found)

    def model(keys):
        target = Counter(gram for key in keys for gram in grams[key])
        sizes = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
        return lambda key: sum(
            math.log((target[gram] + 1) / sizes[0]) - math.log((raw[gram] + 1) / sizes[1])
            for gram in grams[key]
        )

    good = [key for key, wanted, toxic in labels if wanted and not toxic]
    weights = {key: model(good)(key) for key in grams}
    others = [model([key for key in good if halves[key] != half]) for half in range(2)]
    scored = [(others[halves[key]](key), bool(wanted)) for key, wanted, _ in labels]
    at_least = quality.threshold(scored)
    keys = {key: weights[key] + noise[key] for key in weights}
    k = sum(weight >= at_least for weight in weights.values())
    kept = set(sorted(keys, key=keys.get)[::-1][:k])
    return {key: (weights[key], keys[key], key in kept) for key in weights}


def test_resampling_equals_plain_python(spark):
    rows, labels = judged(spark, 200)
    labels = [(key, wanted, int(key % 11 == 0)) for key, wanted, _ in labels]
    expected = plain_resample(spark, rows, labels)
    found = quality.resample(samples.documents(spark, rows), spark.createDataFrame(labels, LABELS))
    columns = found.select("_doc.doc_id", "log_weight", "sample_key", "kept").collect()
    assert len(columns) == len(expected)
    for key, weight, sample_key, kept in columns:
        assert (weight, sample_key) == pytest.approx(expected[key][:2], abs=1e-6)
        assert kept == expected[key][2]


def test_quality_of_awkward_documents(spark):
    docs = samples.documents(spark)
    labels = [(n, n % 2, 0) for n in range(40)] + [(None, 1, 0), (41, None, 0), (3, 1, None), (3, 0, 1)]
    found = quality.resample(docs, spark.createDataFrame(labels, LABELS))
    assert found.count() == docs.count()
    assert found.filter("_doc.text is null").select("log_weight").collect() == [(0.0,)]
    none = quality.resample(docs, spark.createDataFrame([], LABELS))
    assert none.filter("kept").count() == docs.count()
    assert quality.resample(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_kth_largest(spark):
    draw = random.Random(6)
    numbers = [draw.randrange(-(1 << 50), 1 << 50) for _ in range(300)] + [5] * 20 + [-5, 0]
    df = spark.createDataFrame([(n,) for n in numbers], "v bigint").repartition(3)
    ranked = sorted(numbers, reverse=True)
    for k in (1, 7, 150, 160, len(numbers)):
        assert quality.kth_largest(df, k) == ranked[k - 1]
    assert quality.kth_largest(df, 0) is None


def test_threshold():
    scored = [(-3.0, False), (-2.0, False), (-1.0, True), (2.0, True)] * 50
    assert quality.threshold(scored) == -1.0
    assert quality.threshold([(1.0, True)]) == float("-inf")


# Language model


def token_lists(rows):
    return [((key, text), (text or "").encode().lower().split() + [None]) for key, text, *_ in rows]


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7


def check_base(spark, rows, df=None):
    df = samples.documents(spark, rows) if df is None else df
    tokens = token_lists(rows)
    train = Counter(t for (key, _), words in tokens if fold(key) != 2 for t in words)
    total, distinct = sum(train.values()), len(train)
    expected = []
    for (key, _), words in tokens:
        base = sum(math.log10((train[t] + 1) / (total + distinct + 1)) for t in words)
        known = sum(train[t] > 0 for t in words)
        expected.append((key, fold(key) == 2, len(words), known, total, round(base, 6)))
    found = language_model.score(df)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))
    assert values(found, *columns) == sorted(expected, key=repr)
    return found


def test_base_scores_and_better_models(spark):
    draw = random.Random(12)
    chain = {n: [draw.randrange(50) for _ in range(3)] for n in range(50)}
    rows = []
    for n in range(300):
        word, words = draw.randrange(50), []
        for _ in range(draw.choice([5, 40, 100])):
            words.append(f"w{word}")
            word = draw.choice(chain[word])
        rows.append((n, " ".join(words), "en", "s", 0))
    held = check_base(spark, rows).filter("held_out").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    # Three successors each: far fewer bits than fifty words.
    assert held[0] > 0.6 * held[1]


def test_awkward_documents_are_scored(spark):
    rows = samples.awkward_documents()
    check_base(spark, rows, samples.documents(spark, rows, clashes=True))
    assert language_model.score(samples.documents(spark, [])).collect() == []


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rows = samples.awkward_documents()
    rows += [(400 + n, "the the of " * (200 + n), "en", "s", 0) for n in range(12)]
    one = values(language_model.score(samples.documents(spark, rows)), "doc_id", F.round("score", 6))
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1000)
    monkeypatch.setattr(language_model, "HOT_SHARE", 100)
    monkeypatch.setattr(language_model, "HOT_PAIR_SHARE", 200)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 3000)
    hot_pairs = []
    plain = language_model._pair_counts

    def watched(known, packed):
        hot_pairs.extend(known.pairs)
        return plain(known, packed)

    monkeypatch.setattr(language_model, "_pair_counts", watched)
    many = values(language_model.score(samples.documents(spark, rows)), "doc_id", F.round("score", 6))
    assert one == many
    assert hot_pairs


def test_scores_do_not_depend_on_what_words_are_called(spark, monkeypatch):
    draw = random.Random(21)
    texts = [[int(draw.random() ** 3 * 60_000) for _ in range(200)] for _ in range(300)]
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)
    found = []
    for name in ("x{}", "{}-other"):
        rows = [(n, " ".join(map(name.format, words)), "en", "s", 0) for n, words in enumerate(texts)]
        found.append(values(language_model.score(samples.documents(spark, rows)), "doc_id", "score"))
    for one, other in zip(*found, strict=True):
        assert one[0] == other[0]
        assert one[1] == pytest.approx(other[1], rel=1e-9)


def plain_scores(rows):
    """Deleted interpolation over whole tokens, from dictionaries; ratios in quarters of an octave."""
    texts = [(fold(key), [None, *words]) for (key, _), words in token_lists(rows)]

    def counted(folds):
        own = [words for number, words in texts if number in folds]
        single = Counter(word for words in own for word in words[1:])
        pair = Counter(both for words in own for both in zip(words, words[1:], strict=False))
        return single, pair, sum(single.values())

    def ratio(share, distinct):
        return 2.0 ** (round(4 * math.log2(share * (distinct + 1))) / 4) if share else 0.0

    single, pair, total = counted({0, 1, 4, 5, 6})
    events = Counter()
    for number, words in texts:
        for before, word in zip(words, words[1:], strict=False) if number == 3 else ():
            after = pair[before, word] / max(1, single[before])
            shares = (ratio(share, len(single)) for share in (after, single[word] / total))
            events[int(math.log2(single[before] + 1)), *shares] += 1

    def fit(own):
        ratios = np.array([(*key[1:], 1.0) for key in own]).T
        n, weights = np.array([events[key] for key in own]), np.full(3, 1 / 3)
        for _ in range(200):
            shares = weights[:, None] * ratios
            new = (shares / shares.sum(axis=0) * n).sum(axis=1) + 1
            weights, old = new / new.sum(), weights
            if np.abs(weights - old).max() < 1e-9:
                break
        return weights

    buckets = {key[0] for key in events}
    weights = {bucket: fit([key for key in events if key[0] == bucket]) for bucket in buckets}
    overall = fit(list(events))
    single, pair, total = counted({0, 1, 3, 4, 5, 6})
    found = []
    for (key, *_), (_, words) in zip(rows, texts, strict=True):
        whole = 0.0
        for before, word in zip(words, words[1:], strict=False):
            w = weights.get(int(math.log2(single[before] + 1)), overall)
            after = pair[before, word] / max(1, single[before])
            whole += math.log10(w[0] * after + w[1] * single[word] / total + w[2] / (len(single) + 1))
        found.append((key, whole))
    return sorted(found)


def test_scores_equal_plain_deleted_interpolation(spark, monkeypatch):
    draw = random.Random(22)
    # Some forty occurrences per type, and most types below that.
    rows = []
    for n in range(300):
        words = [f"x{int(draw.random() ** 6 * 1500)}" for _ in range(200)]
        rows.append((n, " ".join(words), "en", "s", 0))
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)
    found = values(language_model.score(samples.documents(spark, rows)), "doc_id", "score")
    for (key, score), (plain_key, plain) in zip(sorted(found), plain_scores(rows), strict=True):
        assert key == plain_key
        assert score == pytest.approx(plain, rel=1e-7)


def test_model_is_a_distribution():
    draw = np.random.default_rng(2)
    distinct, contexts = 30, 4
    pairs = draw.integers(0, 9, (contexts, distinct))
    single = pairs.sum(axis=0)
    weights = language_model.learn_weights(np.array([0, 1, 400]), np.array([5, 2, 9]))
    for context in range(contexts):
        count = pairs[context].sum()
        w = weights[language_model.bucket_of(np.array([count]))[0]]
        p = w[0] * pairs[context] / count + w[1] * single / single.sum() + w[2] / (distinct + 1)
        assert p.sum() + w[2] / (distinct + 1) == pytest.approx(1.0)
        assert (p > 0).all()


def test_weights_maximise_held_out_likelihood():
    cell = [(3 * language_model.CELLS + pair) * language_model.CELLS + 9 for pair in (0, 20, 40)]
    counts = np.array([300, 200, 500])
    weights = language_model.learn_weights(np.array(cell), counts)[3]
    ratio = np.array([0.0, *(2.0 ** ((n - 1) / 4) for n in (20, 40))])

    def likelihood(w):
        return (counts * np.log(w[0] * ratio + w[1] * 2.0**2 + w[2])).sum()

    assert weights.sum() == pytest.approx(1)
    for step in (0.02, -0.02):
        for a, b in ((0, 1), (1, 2), (0, 2)):
            other = weights.copy()
            other[a], other[b] = other[a] + step, other[b] - step
            if (other > 0).all():
                assert likelihood(other) <= likelihood(weights) + 4


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.Vocabulary(path)


def check_bpe(tokenizer, texts):
    library, model = tokenizer
    for text, (ids, decoded, count) in zip(texts, model.encode(texts), strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert [int(number) for number in ids.split()] == expected, text
        assert decoded == library.decode(expected, skip_special_tokens=False)
        assert model.decode(expected) == decoded
        assert count == len(expected)


def test_awkward_texts_encode_as_the_library_does(tokenizer):
    check_bpe(tokenizer, [row[1] for row in samples.awkward_documents()])
    check_bpe(
        tokenizer,
        ["<|endoftext|>a<|startoftext|> <|endoftext", "I'm we'LL don't 'S", "aaaa aaaaa !!!!!!", "İ Σς ὈΣ",
         "é ́ Å ﬁ ​\x1c\x85　x", "՘ Ᲊ Ɤ ̧ࢗ", "!" * 9999, "é" * 5000],
    )


def test_random_texts_encode_as_the_library_does(tokenizer):
    draw = random.Random(3)
    codes = [chr(code) for code in range(1, 0x30000) if not 0xD800 <= code < 0xE000]
    texts = ["".join(draw.choices(codes[: draw.choice([0x250, 0x3000, 0x2F000])], k=30)) for _ in range(400)]
    texts += ["".join(draw.choices("abeinrst'!1 é", k=40)) for _ in range(400)]
    check_bpe(tokenizer, texts)


def test_few_known_words_are_kept(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KNOWN_WORDS", 10)
    monkeypatch.setattr(bpe, "CHARACTERS_AT_ONCE", 100)
    check_bpe(tokenizer, [row[1] for row in samples.awkward_documents(5)])


def test_ids_and_digests_of_a_table(spark, tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = samples.documents(spark, clashes=True).withColumn("ids", F.lit("old"))
    library, _ = tokenizer
    encoded = bpe.encode(docs, path).collect()
    assert len(encoded) == docs.count()
    for row in encoded:
        assert row["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
    for row in bpe.token_digests(docs.select("doc_id", "text", F.col("text").alias("whole")), path).collect():
        ids = library.encode(row["whole"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), path).collect() == []


# Chat

TURNS = "conv_id bigint, turn bigint, role string, text string, example int"


def conversations(seed=2):
    draw = random.Random(seed)
    control = ["</s>", "<s>", "[INST]", "[/INST]", "[TEXT]", "<\\s>", "<\\\\/s>", "\n", "\\", "é🙂", "ok "]
    rows = []
    for conv in range(30):
        for turn in range(draw.choice([1, 2, 5, 30])):
            role = draw.choice(["user", "assistant", "assistant", "system", "a[TEXT]b", "", None])
            rows.append((conv, turn, role, "".join(draw.choices(control, k=draw.randrange(8)))))
    rows += [(40, 0, "assistant", None), (41, None, "user", "x"), (41, 1, "assistant", "y" * 50_000)]
    rows += [(42, 0, "user", "same")] * 3 + [(42, 0, "assistant", "same")] * 2
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    return rows


def summary_of(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = []
    for conv, own in turns.items():
        own.sort()
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        learnt = "".join(text for _, _, role, text in own if role == "assistant")
        hashes = [hashlib.sha256(part.encode()).hexdigest() for part in (whole, learnt)]
        found.append((conv, len(own), hashes[0], len(learnt), hashes[1]))
    return sorted(found, key=repr)


def test_examples_hold_every_turn_and_learn_each_reply_once(spark):
    rows = conversations()
    df = spark.createDataFrame([(*row, 1) for row in rows], TURNS).repartition(6)
    examples = chat.expand(df)
    found = chat.read_back(examples)
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert values(found, *columns) == summary_of(rows)
    replies = sum(role == "assistant" for _, _, role, _ in rows)
    assert examples.filter("loss_end > loss_start or text like '%<s></s>'").count() >= replies
    lengths = examples.groupBy("conv_id").agg(F.sum(F.length("text")))
    assert values(lengths) == values(found, "conv_id", "formatted_chars")


def test_contexts_grow_turn_by_turn(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "t")]
    df = spark.createDataFrame([(*row, 1) for row in rows], TURNS)
    first = "[INST]user[TEXT]q[/INST]<s>a</s>"
    second = first + "[INST]user[TEXT]r[/INST]<s>b</s>"
    third = second + "[INST]user[TEXT]t[/INST]"
    texts = chat.expand(df).orderBy("example").collect()
    assert [row["text"] for row in texts] == [first, second, third]
    assert [row["text"][row["loss_start"] : row["loss_end"]] for row in texts] == ["a", "b", ""]


def test_escapes_are_exact():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices("<>/s\\[]INSTEX", k=draw.randrange(14))) + draw.choice(chat.CONTROLS)
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(control in escaped for control in chat.CONTROLS)


def test_no_conversations(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], TURNS))).collect() == []


@pytest.mark.parametrize("span", [3, 200, 1 << 40, 1 << 62])
def test_combined_numbers_sort_like_their_columns(span):
    draw = np.random.default_rng(span % 97)
    columns = [draw.integers(0, span, 3000) * draw.integers(0, 2, 3000) for _ in range(5)]
    columns[1] = columns[1].astype(np.uint64) + np.uint64(1 << 63)
    key = language_model._combined(*columns)
    rows = list(zip(*(column.tolist() for column in columns), strict=True))
    place = {row: number for number, row in enumerate(sorted(set(rows)))}
    assert np.unique(key, return_inverse=True)[1].tolist() == [place[row] for row in rows]
    assert not len(language_model._combined(*(column[:0] for column in columns)))


def test_numbers_of_tokens_and_contexts():
    texts = [b"a b A", b"", b" c\ta ", b"b"]
    tokens = language_model.Tokens(language_model.PrefixHash(64), texts)
    distinct, token, context = tokens.numbered()
    assert (np.diff(distinct.astype(object)) > 0).all()
    assert (distinct[token] == tokens.token).all() and (distinct[context] == tokens.context).all()
