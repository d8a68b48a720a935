"""Prefix sums, row numbers, fills, lags and positional joins over keys of any size.

A window without ``partitionBy`` sorts all rows in one task. Here the rows are stored, dealt into
ranges of the order key by Spark's own range partitioning and stored again, each with its range and
its place in it. What ranges pass on to later ones (a total, a last value) is one row a range; these
rows are summed up in groups of a thousand, the groups in groups again, so no task gets more than
a thousand of them and the plan grows only with the depth of that tree. The stored ranges keep
every row where it is if a task runs again. The order has to be unique as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trendline.workspace import written_once

RANGE, PLACE = "_range", "_place"
PLACE_BITS = 33  # of monotonically increasing numbers: the range is above them
FAN = 1_000
MOST_BROADCAST_RANGES = 1_000_000
BLOCK_ROWS = 1_000_000


def _as_sequence(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def in_ranges(
    df: DataFrame, order: str | Sequence[str], ranges: int | None = None
) -> tuple[DataFrame, int]:
    """The stored rows with their range and their place in it from 0 on, and how many ranges.

    There are as many ranges as the session has shuffle partitions, if not told otherwise. The rows
    are stored before they are dealt, as range partitioning reads them twice.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [_column(name) for name in _as_sequence(order)]
    stored = written_once(df, "unordered")
    dealt = stored.repartitionByRange(max(ranges, 2), *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn(PLACE, F.monotonically_increasing_id()).withColumns(
        {
            RANGE: F.shiftright(PLACE, PLACE_BITS),
            PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
        }
    )
    return written_once(dealt, "ranges"), max(ranges, 2)


@dataclass(frozen=True)
class Carry:
    """What a range takes over from all ranges before it, or after it.

    ``over`` gives it within a window, ``together`` for a group of ranges, ``joined`` puts that
    of the own group and that of other groups together. What comes from behind is a window over
    the rows in descending order: one that ends with the last row is worked out anew for each row.
    """

    over: Callable[[Column, WindowSpec], Column]
    together: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]
    backwards: bool = False

    def span(self, by: str, order: str, last_row: int) -> WindowSpec:
        """The rows that are handed over, up to some place from the current row."""
        way = F.desc(order) if self.backwards else F.asc(order)
        return Window.partitionBy(by).orderBy(way).rowsBetween(Window.unboundedPreceding, last_row)


SUM = Carry(
    lambda value, span: F.sum(value).over(span),
    F.sum,
    lambda own, other: F.coalesce(own + other, own, other),
)
LAST = Carry(
    lambda value, span: F.last(value, ignorenulls=True).over(span),
    lambda value: F.max_by(value, F.when(value.isNotNull(), F.col(RANGE))),
    F.coalesce,
)
NEXT = Carry(
    lambda value, span: F.last(value, ignorenulls=True).over(span),
    lambda value: F.min_by(value, F.when(value.isNotNull(), F.col(RANGE))),
    F.coalesce,
    backwards=True,
)


def carried(totals: DataFrame, names: Sequence[str], ranges: int, carry: Carry) -> DataFrame:
    """For each range, what the ranges on one side of it hand over, under the same names.

    ``totals`` has a row for each range (or fewer, if some are empty) with ``names`` of its own.
    """
    group = F.floor(F.col(RANGE) / F.lit(FAN)).alias("_group")
    span = carry.span("_group", RANGE, -1)
    rows = totals.select(RANGE, group, *names)
    own = rows.select(RANGE, "_group", *[carry.over(F.col(n), span).alias(n) for n in names])
    if ranges <= FAN:
        return own.drop("_group")
    groups = rows.groupBy("_group").agg(*[carry.together(F.col(n)).alias(n) for n in names])
    groups = groups.withColumnRenamed("_group", RANGE)
    other = carried(groups, names, -(-ranges // FAN), carry)
    other = other.toDF("_group", *[f"_other_{n}" for n in names])
    return own.join(other, "_group").select(
        RANGE, *[carry.joined(F.col(n), F.col(f"_other_{n}")).alias(n) for n in names]
    )


def _with_carried(rows: DataFrame, handed: DataFrame, ranges: int) -> DataFrame:
    """One row a range meets all rows of the range."""
    return rows.join(F.broadcast(handed) if ranges <= MOST_BROADCAST_RANGES else handed, RANGE)


def running_sum(
    df: DataFrame,
    order: str | Sequence[str],
    value: Column,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to the current one."""
    rows, ranges = in_ranges(df.withColumn(out, value), order, ranges)
    within = Window.partitionBy(RANGE).orderBy(PLACE)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(RANGE).agg(F.sum(_column(out)).alias("_before"))
    before = carried(totals, ["_before"], ranges, SUM)
    total_type = before.schema["_before"].dataType
    summed = rows.withColumn(out, F.sum(_column(out)).over(within))
    inside, earlier = _column(out), F.col("_before")
    return (
        _with_carried(summed, before, ranges)
        .withColumn(out, F.coalesce(inside + earlier, inside, earlier).cast(total_type))
        .drop(RANGE, PLACE, "_before")
    )


def row_index(
    df: DataFrame, order: str | Sequence[str], out: str = "id", ranges: int | None = None
) -> DataFrame:
    """Numbers the rows 1, 2, 3, ... along the order key, without a window over them."""
    rows, ranges = in_ranges(df, order, ranges)
    totals = rows.groupBy(RANGE).agg(F.count("*").alias("_before"))
    before = carried(totals, ["_before"], ranges, SUM)
    number = F.coalesce("_before", F.lit(0)) + F.col(PLACE) + F.lit(1)
    numbered = _with_carried(rows, before, ranges).withColumn(out, number)
    return numbered.drop(RANGE, PLACE, "_before")


def _filled(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Sequence[str],
    zero_is_missing: bool,
    ranges: int | None,
    carry: Carry,
) -> DataFrame:
    rows, ranges = in_ranges(df, order, ranges)
    known = {
        name: F.nullif(_column(name), F.lit(0)) if zero_is_missing else _column(name)
        for name in columns
    }
    handed_names = [f"_handed{place}" for place in range(len(columns))]
    edge = F.max_by if carry is LAST else F.min_by
    totals = rows.groupBy(RANGE).agg(
        *[
            edge(value, F.when(value.isNotNull(), F.col(PLACE))).alias(handed)
            for handed, value in zip(handed_names, known.values(), strict=True)
        ]
    )
    handed = carried(totals, handed_names, ranges, carry)
    within = carry.span(RANGE, PLACE, Window.currentRow)
    rows = rows.withColumns({name: carry.over(value, within) for name, value in known.items()})
    met = _with_carried(rows, handed, ranges)
    return met.withColumns(
        {
            name: F.coalesce(_column(name), F.col(handed))
            for name, handed in zip(columns, handed_names, strict=True)
        }
    ).select(*[_column(name) for name in df.columns])


def forward_fill(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Sequence[str],
    zero_is_missing: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Each missing value becomes the last known one before it, NULL where there is none."""
    return _filled(df, order, columns, zero_is_missing, ranges, LAST)


def back_fill(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Sequence[str],
    zero_is_missing: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Each missing value becomes the next known one after it, NULL where there is none."""
    return _filled(df, order, columns, zero_is_missing, ranges, NEXT)


def lag_rows(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Mapping[str, str],
    rows: int,
    ranges: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the values some rows before; ``columns`` maps each source to its output.

    Numbered rows form blocks of equal length. The last rows of a block go to the next one as well,
    as the halo that its first rows look back to, so each block is a window of its own.
    """
    if not 0 < rows <= block_rows:
        raise ValueError(f"{rows} rows back in blocks of {block_rows}")
    numbered = row_index(df, order, "_position", ranges)
    step = F.col("_position") - F.lit(1)
    own = F.floor(step / F.lit(block_rows))
    blocks = F.when(
        F.pmod(step, F.lit(block_rows)) >= F.lit(block_rows - rows), F.array(own, own + 1)
    ).otherwise(F.array(own))
    dealt = numbered.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    span = Window.partitionBy("_block").orderBy("_position")
    lagged = dealt.withColumns(
        {out: F.lag(_column(source), rows).over(span) for source, out in columns.items()}
    )
    return lagged.filter("_own = _block").drop("_own", "_block", "_position")


def lagged_change(
    df: DataFrame,
    order: str | Sequence[str],
    columns: Mapping[str, str],
    rows: int,
    ranges: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the change of each column since some rows before, 0 where there is no such row."""
    before = {source: f"_before{place}" for place, source in enumerate(columns)}
    lagged = lag_rows(df, order, before, rows, ranges, block_rows)
    changes = {
        out: F.coalesce(_column(source) - F.col(before[source]), F.lit(0))
        for source, out in columns.items()
    }
    return lagged.withColumns(changes).drop(*before.values())


def zip_by_position(
    left: DataFrame,
    right: DataFrame,
    left_order: str | Sequence[str],
    right_order: str | Sequence[str],
    out: str = "id",
    ranges: int | None = None,
) -> DataFrame:
    """Joins the n-th row of one frame with the n-th row of the other.

    Both orders must be unique, so the result does not depend on how the frames
    are partitioned. The longer frame loses its surplus rows.
    """
    return row_index(left, left_order, out, ranges).join(
        row_index(right, right_order, out, ranges), out, "inner"
    )
