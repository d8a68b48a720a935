"""Awkward inputs that every corpus operator has to take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside; as extra columns they must do no harm.
CLASHES = (
    "_id _doc _text _row _key _full _n _sum _target fp key fold chunk kind mark hash size target "
    "taken copies kept rank score log_weight bucket shard row vector"
).split()


def prose(draw: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(draw.random() ** 2 * vocabulary)}" for _ in range(words))


def awkward_documents(seed: int = 1, count: int = 60) -> list[tuple]:
    """Copies, near copies, repeated rows, NULLs in every column, empty and long texts."""
    draw = random.Random(seed)
    rows = [(n, prose(draw, draw.choice([1, 2, 5, 60, 200])), "en", f"s{n % 3}") for n in range(count)]
    rows += [(100 + n, rows[n][1].upper(), "en", "s0") for n in range(0, 20, 2)]
    for n in range(0, 20, 3):
        words = rows[n][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + n, " ".join(words), "en", "s1"))
    rows += [(300, None, None, None), (301, "", "de", "s2"), (302, " \n\t", "de", None)]
    rows += [(303, prose(draw, 30_000), "en", "s1"), (304, "É é ÀA ßẞ İı Σς 漢字 🙂", "fr", "é")]
    rows += [rows[5], rows[5], (None, rows[7][1], None, "s1"), (None, "lone", "en", "s2")]
    rows += [(7, "another text under a number that is taken", "en", "s0")]
    return [(*row, None if row[1] is None else len(row[1])) for row in rows]


def documents(spark, rows=None, clashes: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_documents() if rows is None else rows, DOCUMENTS)
    if clashes:
        df = df.select("*", *[F.lit(n).alias(name) for n, name in enumerate(CLASHES)])
    return df.repartition(5)
