"""Headline figures of a daily series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_ROWS = 8
RANK = "_latest"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def latest_rows(series: DataFrame, order: str, k: int, columns: Sequence[str]) -> DataFrame:
    """The last k rows of the series, newest first, cut down to some columns."""
    return series.orderBy(F.desc(order)).limit(k).select(*[column(name) for name in columns])


def metric_total(series: DataFrame, metric: str, out: str) -> DataFrame:
    return series.agg(F.sum(column(metric)).alias(out))


def latest_sum(series: DataFrame, order: str, metric: str, out: str, k: int = 7) -> DataFrame:
    """Sum over the last k rows, 0 if none has a value."""
    return latest_rows(series, order, k, [metric]).agg(
        F.coalesce(F.sum(column(metric)), F.lit(0)).alias(out)
    )


def latest_value(series: DataFrame, order: str, metric: str, out: str) -> DataFrame:
    """The value in the last row, NULL if that row has none."""
    return series.agg(F.max_by(column(metric), order).alias(out))


@dataclass(frozen=True)
class Kpi:
    """One figure: its name, its metric and how it comes from the ranked rows.

    ``kind`` is ``total``, ``recent_sum``, ``latest``, ``above_high`` (latest
    minus the highest of the recent rows) or ``above_low`` (latest minus the
    lowest). ``null_as_zero`` makes a missing latest value 0.
    """

    name: str
    metric: str
    kind: str
    rows: int = RECENT_ROWS
    null_as_zero: bool = False

    def _latest(self) -> Column:
        latest = F.max(F.when(F.col(RANK) == 1, column(self.metric)))
        return F.coalesce(latest, F.lit(0)) if self.null_as_zero else latest

    def expression(self) -> Column:
        metric = column(self.metric)
        recent = F.when(F.col(RANK) <= self.rows, metric)
        match self.kind:
            case "total":
                figure = F.sum(metric)
            case "recent_sum":
                figure = F.coalesce(F.sum(recent), F.lit(0))
            case "latest":
                figure = self._latest()
            case "above_high":
                figure = self._latest() - F.max(recent)
            case "above_low":
                figure = self._latest() - F.min(recent)
            case _:
                raise ValueError(f"unknown kind of figure: {self.kind}")
        return figure.alias(self.name)


def _ranked_latest(series: DataFrame, order: str, k: int) -> DataFrame:
    """The last k rows with their rank, the newest first, without a window over the series."""
    latest = series.orderBy(F.desc(order)).limit(k)
    rows = F.sort_array(F.collect_list(F.struct(order, F.struct("*").alias("row"))), asc=False)
    ranked = latest.agg(rows.alias("rows")).select(F.posexplode("rows").alias(RANK, "latest"))
    return ranked.select((F.col(RANK) + 1).alias(RANK), "latest.row.*")


def kpi_rows(
    series: DataFrame, order: str, kpis: Sequence[Kpi], partition_by: Sequence[str] = ()
) -> DataFrame:
    """All figures in one row (per segment), with the latest date, in one pass.

    The series must have one row per date (and segment).
    """
    newest_first = Window.partitionBy(*partition_by).orderBy(F.desc(order))
    ranked = series.withColumn(RANK, F.row_number().over(newest_first))
    figures = [F.max(order).alias(order), *[kpi.expression() for kpi in kpis]]
    return ranked.groupBy(*partition_by).agg(*figures)


def stored_kpi_row(series: DataFrame, order: str, kpis: Sequence[Kpi]) -> DataFrame:
    """All figures of a stored series in one row, with the latest date.

    The series is read twice, once for its latest rows and once for its totals, and no more than
    these rows and the partial sums leave the tasks. For series that are cheap to read again.
    """
    totals = [kpi for kpi in kpis if kpi.kind == "total"]
    recent = [kpi for kpi in kpis if kpi.kind != "total"]
    ranked = _ranked_latest(series, order, max([1, *(kpi.rows for kpi in recent)]))
    found = ranked.agg(F.max(order).alias(order), *[kpi.expression() for kpi in recent])
    if totals:
        found = glue_single_rows(found, series.agg(*[kpi.expression() for kpi in totals]))
    return found.select(order, *[column(kpi.name) for kpi in kpis])


def glue_single_rows(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side.

    Each frame is a scalar subquery, so a frame with more than one row is an
    error and not a product of rows.
    """
    rows = [
        frame.select(F.struct("*")).scalar().alias(f"_{position}")
        for position, frame in enumerate(frames)
    ]
    glued = frames[0].sparkSession.range(1).select(*rows)
    return glued.select(*[f"_{position}.*" for position in range(len(frames))])
