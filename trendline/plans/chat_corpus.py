"""Training texts out of stored conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendline.functions import fixed_values
from trendline.operators.ordered import row_index

Render = Callable[[Column, Column], Column]

# Fixed value: what the pattern for white space covers.
WHITE_SPACE = " \t\n\x0b\f\r"

TURNS_AT_ONCE = 64
SALTS = 64
GROUPED_BATCHES = 50


def role_heading(role: Column, text: Column) -> Column:
    role, text = (F.coalesce(value, F.lit("")) for value in (role, text))
    return F.concat(F.lit("### "), role, F.lit(": "), text)


def load_split(corpus: DataFrame, column: str, split: str) -> DataFrame:
    """The rows of one named split; on files, Spark hands the test to the scan."""
    return corpus.filter(F.col(column) == F.lit(split))


def store_splits(corpus: DataFrame, column: str, path: str) -> None:
    """Writes the corpus with a folder for each split.

    ``load_split`` then lists and reads the files of its own split alone. A split may hold most
    rows; every task writes what it has of it, so none is gathered.
    """
    corpus.write.mode("overwrite").partitionBy(column).parquet(path)


def _joined(piece: Column, separator: str) -> Column:
    """The text of structs of a place and a piece, in the order of the places."""
    return F.array_join(F.sort_array(F.collect_list(piece))["_piece"], separator)


def conversation_texts(
    turns: DataFrame, render: Render = role_heading, turns_per_part: int | None = None
) -> DataFrame:
    """The rendered turns of each conversation as one text, in order.

    Runs of 64 turn numbers are put together first, so many tasks share the work of an endless
    conversation and the last step only joins a few long strings; a text that no value can hold
    fails and is never cut. A missing role or text counts as empty. With ``turns_per_part``, a
    conversation comes in parts of so many turn numbers, told apart by ``part``.
    """
    size = turns_per_part or TURNS_AT_ONCE
    part = F.expr(f"turn div {size}").alias("part")
    rendered = turns.select(
        "conv_id", part, "turn", render(F.col("role"), F.col("text")).alias("_piece")
    )
    parts = rendered.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_turns"), _joined(F.struct("turn", "_piece"), "\n").alias("text")
    )
    if turns_per_part:
        return parts
    return parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        _joined(F.struct("part", F.col("text").alias("_piece")), "\n").alias("text"),
    )


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column) -> Column:
    """The pieces between white space; a blank text is one empty piece."""
    return F.split(_trimmed(text), r"\s+")


def first_tokens(text: Column, max_tokens: int | Column) -> Column:
    """The first tokens of a text, one blank between them."""
    limit = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    return F.array_join(F.slice(tokens(text), F.lit(1), limit), " ")


def truncated_texts(
    turns: DataFrame,
    max_tokens: int = fixed_values.MAX_SEQUENCE_TOKENS,
    render: Render = role_heading,
) -> DataFrame:
    """The first ``max_tokens`` tokens of each conversation and how many they are.

    Turns without a token add nothing; a conversation of such turns has an empty text. Of the others
    only the first ``max_tokens`` can count: they are found first among each 64th part of a
    conversation's turns, then among what is left of all parts. So the last step sees at most 64
    times ``max_tokens`` rows of a conversation, however long it is. The single turns are cut before
    they are moved.
    """
    rendered = render(F.col("role"), F.col("text"))
    blank = _trimmed(rendered) == F.lit("")
    cut = turns.select(
        "conv_id",
        "turn",
        F.when(blank, F.lit("")).otherwise(first_tokens(rendered, max_tokens)).alias("_piece"),
        F.when(blank, F.lit(0))
        .otherwise(F.least(F.size(tokens(rendered)), F.lit(max_tokens)))
        .alias("_n"),
        F.pmod(F.xxhash64("turn"), F.lit(SALTS)).alias("_salt"),
    )
    # Blank turns come last, so that one is left only where there is nothing else.
    order = (F.col("_n") == 0, F.col("turn"), F.col("_piece"))
    in_salt = Window.partitionBy("conv_id", "_salt").orderBy(*order)
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    fewer = cut.withColumn("_place", F.row_number().over(in_salt)).filter(
        F.col("_place") <= max_tokens
    )
    first = fewer.withColumn("_place", F.row_number().over(in_order)).filter(
        F.col("_place") <= max_tokens
    )
    used = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    fitting = first.withColumn("_room", (F.lit(max_tokens) - used).cast("int")).filter("_room > 0")
    shortened = first_tokens(F.col("_piece"), F.col("_room"))
    pieces = fitting.select(
        "conv_id",
        "turn",
        F.least("_n", "_room").alias("_n"),
        F.when(F.col("_n") <= F.col("_room"), F.col("_piece")).otherwise(shortened).alias("_piece"),
    )
    told = F.when(F.col("_n") > 0, F.struct("turn", "_piece"))
    return pieces.groupBy("conv_id").agg(
        F.sum("_n").alias("n_tokens"), _joined(told, " ").alias("text")
    )


def length_batches(
    texts: DataFrame,
    key: str = "conv_id",
    length: str = "n_tokens",
    batch_size: int = fixed_values.BATCH_SIZE,
    accumulation: int = fixed_values.ACCUMULATION,
    max_steps: int | None = None,
) -> DataFrame:
    """Batches of texts of similar length.

    The texts, in the order of their keys, fall into groups of 50 batches; inside
    a group the longest come first. All groups have the same size whatever the
    keys look like, and batch numbers follow from it. ``max_steps`` ends the run
    after that many optimiser steps. Of the texts, key and length are read, once.
    """
    numbered = row_index(texts.select(key, length), key, out="_id")
    if max_steps is not None:
        numbered = numbered.filter(F.col("_id") <= max_steps * accumulation * batch_size)
    numbered = numbered.withColumn("_group", F.expr(f"(_id - 1) div {batch_size * GROUPED_BATCHES}"))
    longest_first = Window.partitionBy("_group").orderBy(F.desc(length), key)
    batch = F.expr(f"_group * {GROUPED_BATCHES} + (_place - 1) div {batch_size}")
    return (
        numbered.withColumn("_place", F.row_number().over(longest_first))
        .select(key, length, batch.alias("batch"))
        .withColumn("step", F.expr(f"batch div {accumulation}"))
    )
