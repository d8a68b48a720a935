"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_REPEATS = 3
SLOT_DIGITS = 4  # hexadecimal digits of the hash key: 65,536 slots a source

SLOTS_PER_PART = 256

KEY, SLOT, PART, SOURCE, BEFORE = "_key", "_slot", "_part", "_source", "_before"


def hash_key(name: Column) -> Column:
    """A random place in the order of a source that stays the same in every run."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(name.cast("string"), F.lit(""))))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """The share of each source in the mix: one row in, one row out.

    ``sizes`` holds ``source`` and ``source_size``. The sources by code point, NULL
    last, weigh ``weights``, repeating, and share the sum of all sizes. No target
    exceeds ``most_repeats`` times its source; the excess goes to the others by
    weight. With the sources in the order of what they can take per unit of
    weight, the full ones come first, and one running sum finds where they end.
    """
    scale = 1
    for weight in set(weights):
        scale *= weight
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(int(weight)) for weight in weights])
    place = (F.row_number().over(by_name) - F.lit(1)) % F.lit(len(weights))
    weighed = sizes.withColumn("weight", F.element_at(listed, place + F.lit(1)))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(most_repeats))
    room = F.expr(f"source_size * ({scale} div weight)")
    by_room = Window.orderBy(room, F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    later = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = weighed.select(
        "*",
        F.row_number().over(by_room).alias("_rank"),
        (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
        ).alias("_left"),
        F.sum("weight").over(later).alias("_weights"),
    )
    level = F.col("_left").cast("double") * F.col("weight") / F.col("_weights")
    full = ranked.withColumn("_full", F.col("_cap").cast("double") <= level)
    open_end = F.min_by(F.struct("_left", "_weights"), F.when(~F.col("_full"), F.col("_rank")))
    found = full.withColumn("_open", open_end.over(everything))
    shared = F.col("_open._left").cast("double") * F.col("weight") / F.col("_open._weights")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(shared)
    return found.select("source", "source_size", "weight", target.alias("target"))


def _tagged(name: Column) -> Column:
    """A source name that is never NULL, for joins."""
    return F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name))


def _sum_before(value: str, per: Sequence[str], order: Sequence[str]) -> Column:
    """The sum over the rows of a group that come before this one."""
    rows = Window.partitionBy(*per).orderBy(*order)
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def mix(
    docs: DataFrame,
    source: str = "source",
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1),
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Adds to each document what a mix of the sources to their weights takes of it.

    New columns: ``source_size``, ``target`` (of the source), ``epochs`` (how often the source goes
    in as a whole), ``taken`` (units of the document in the mix, repeats counted) and ``copies``
    (the same as whole documents: the one at the cut stays whole if half of it or more lies before
    the cut).

    Documents stand in the order of a hash of their key. Within a source the order is cut into
    65,536 slots of equal width, so a source with a third of all rows is spread evenly; slots are
    summed before the shuffle, sorted on their own, and running sums over parts of 256 slots, and in
    each part over its slots, tell what lies before each. The cut lies exactly at the rounded
    target. Empty documents take nothing and count as taken whole when they lie before the cut. NULL
    is a source of its own, a NULL size counts as 0, and rows with the same key and size are
    interchangeable. Other columns stay as they are, whatever their names; a column with one of the
    new names gives way to the new one.
    """
    entries = docs.select(
        F.struct(*[docs[name] for name in docs.columns]).alias("_doc"),
        docs[key].alias("_id"),
        docs[source].alias("_name"),
        F.coalesce(docs[size], F.lit(0)).cast("bigint").alias("_length"),
    )
    placed = entries.withColumns(
        {KEY: hash_key(F.col("_id")), SOURCE: _tagged(F.col("_name"))}
    ).withColumn(SLOT, F.conv(F.substring(KEY, 1, SLOT_DIGITS), 16, 10).cast("int"))
    slots = placed.groupBy(SOURCE, SLOT).agg(
        F.first("_name").alias("_name"), F.sum("_length").alias("_sum")
    )
    slots = slots.withColumn(PART, F.expr(f"{SLOT} div {SLOTS_PER_PART}"))
    parts = slots.groupBy(SOURCE, PART).agg(
        F.first("_name").alias("_name"), F.sum("_sum").alias("_part_sum")
    )
    sizes = parts.groupBy(SOURCE).agg(
        F.first("_name").alias("source"), F.sum("_part_sum").alias("source_size")
    )
    targets = source_targets(sizes.select("source", "source_size"), weights, most_repeats)
    targets = targets.select(
        _tagged(F.col("source")).alias(SOURCE),
        F.col("source_size").alias("_size"),
        F.col("target").alias("_target"),
    )
    part_offsets = parts.select(
        SOURCE, PART, _sum_before("_part_sum", [SOURCE], [PART]).alias("_part_offset")
    ).join(targets, SOURCE)
    offset = F.col("_part_offset") + _sum_before("_sum", [SOURCE, PART], [SLOT])
    offsets = slots.join(part_offsets, [SOURCE, PART]).select(
        SOURCE, SLOT, offset.alias("_offset"), "_size", "_target"
    )
    before = F.col("_offset") + _sum_before("_length", [SOURCE, SLOT], [KEY, "_id", "_length"])
    budget = F.floor(F.col("_target") + F.lit(0.5)).cast("bigint")
    ordered = placed.join(offsets, [SOURCE, SLOT]).withColumns(
        {BEFORE: before, "_budget": budget}
    )
    ordered = ordered.withColumn(
        "_epochs", F.when(F.col("_size") > 0, F.expr("_budget div _size")).otherwise(F.lit(0))
    )
    rest = F.col("_budget") - F.col("_epochs") * F.col("_size") - F.col(BEFORE)
    part = F.greatest(F.lit(0), F.least(F.col("_length"), rest))
    more = F.when(rest > 0, (part * F.lit(2) >= F.col("_length")).cast("bigint")).otherwise(0)
    added = {
        size: F.col("_length"),
        "source_size": F.col("_size"),
        "target": F.col("_target"),
        "epochs": F.col("_epochs").cast("bigint"),
        "taken": (F.col("_epochs") * F.col("_length") + part).cast("bigint"),
        "copies": (F.col("_epochs") + more).cast("bigint"),
    }
    own = [name for name in docs.columns if name not in added]
    return ordered.select(
        *[F.col("_doc")[name].alias(name) for name in own],
        *[value.alias(name) for name, value in added.items()],
    )


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    times = F.expr("sequence(1L, copies)")
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(times))
    return taken.select(*[F.col(f"`{column}`") for column in columns])
