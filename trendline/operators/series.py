"""Windows over daily series.

A daily series has at most one row per calendar day (and segment), because it
comes out of an aggregation by date. Its length is bounded by the calendar and
not by the number of events, so a window over one whole series is a small task
however large the source is. Ordered work on keys without such a bound belongs
in ``ordered.py``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trendline.functions import fixed_values


def in_order(order: str, partition_by: Sequence[str | Column] = ()) -> WindowSpec:
    return Window.partitionBy(*partition_by).orderBy(order)


def so_far(order: str, partition_by: Sequence[str | Column] = ()) -> WindowSpec:
    """The rows up to and including the current one."""
    return in_order(order, partition_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_here(order: str, partition_by: Sequence[str | Column] = ()) -> WindowSpec:
    """The current row and all later ones."""
    return in_order(order, partition_by).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def known(column: str, zero_is_missing: bool = True) -> Column:
    """The value, or NULL where it counts as missing."""
    value = F.col(f"`{column}`")
    return F.nullif(value, F.lit(0)) if zero_is_missing else value


def cumulative(
    series: DataFrame, order: str, columns: Mapping[str, str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Running totals; ``columns`` maps each source column to its output."""
    span = so_far(order, partition_by)
    return series.withColumns(
        {out: F.sum(F.col(f"`{source}`")).over(span) for source, out in columns.items()}
    )


def complete_dates(
    series: DataFrame,
    spine: DataFrame,
    order: str = "Date",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The series on every date of the spine and of its own.

    A date that only the series knows keeps its date. Numbers missing on the
    added dates are 0.
    """
    return series.join(spine, [*partition_by, order], "full").na.fill(0)


def forward_fill(
    series: DataFrame,
    order: str,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    zero_is_missing: bool = True,
) -> DataFrame:
    """Each missing value becomes the last known one before it."""
    span = so_far(order, partition_by)
    return series.withColumns(
        {c: F.last(known(c, zero_is_missing), ignorenulls=True).over(span) for c in columns}
    )


def back_fill(
    series: DataFrame, order: str, columns: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Each NULL becomes the next known value after it."""
    span = from_here(order, partition_by)
    return series.withColumns(
        {c: F.first(F.col(f"`{c}`"), ignorenulls=True).over(span) for c in columns}
    )


def change_since(column: str, rows: int, span: WindowSpec) -> Column:
    """Difference to the value some rows before, 0 where there is none."""
    value = F.col(f"`{column}`")
    return F.coalesce(value - F.lag(value, rows).over(span), F.lit(0))


def row_average(
    series: DataFrame,
    order: str,
    columns: Mapping[str, str],
    rows: int = fixed_values.AVERAGE_ROWS,
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Mean daily growth of running totals over the last rows, to one decimal."""
    span = in_order(order, partition_by)
    return series.withColumns(
        {
            out: F.round(change_since(total, rows, span) / F.lit(rows), 1)
            for total, out in columns.items()
        }
    )


def lagged_change(
    series: DataFrame,
    order: str,
    columns: Mapping[str, tuple[str, int]],
    partition_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Change of each column; ``columns`` maps the source to its output and rows back."""
    span = in_order(order, partition_by)
    return series.withColumns(
        {out: change_since(source, rows, span) for source, (out, rows) in columns.items()}
    )
