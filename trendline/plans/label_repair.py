"""Repair of the label columns of sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendline.functions import fixed_values
from trendline.functions.labels import join_range_label, week_label_day
from trendline.operators.combine import rename_by_lookup
from trendline.operators.ordered import row_index, zip_by_position


def repair_age_sheet(
    sheet: DataFrame,
    order: str | Sequence[str],
    label: str = "age_group_new",
    dates: Sequence[str] = ("current_date:", "yesterday_date:"),
) -> DataFrame:
    """Numbers the rows, makes dates of the time columns and adds ``age_group``.

    A row-wise repair: repeated labels stay as many rows as they were.
    """
    typed = sheet.withColumns({name: F.to_date(F.col(f"`{name}`")) for name in dates})
    labelled = typed.withColumn("age_group", join_range_label(F.col(f"`{label}`")))
    return row_index(labelled, order)


def repair_week_sheet(sheet: DataFrame, label: str = "week") -> DataFrame:
    """Adds the day that a week label ends with."""
    return sheet.withColumn("Transformed_Date", week_label_day(F.col(label)))


def rename_regions(
    sheet: DataFrame, names: Mapping[str, str], key: str = "public_health_unit"
) -> DataFrame:
    """Adds the short name of each region by lookup."""
    return rename_by_lookup(sheet, names, key, "new_PHUnames")


def rename_regions_in_order(
    sheet: DataFrame,
    order: str | Sequence[str],
    names: Sequence[str] = fixed_values.REGION_SHORT_NAMES,
) -> DataFrame:
    """Adds the n-th short name to the n-th row of the sheet."""
    short = sheet.sparkSession.createDataFrame(
        pa.table({"_position": list(range(len(names))), "new_PHUnames": list(names)})
    )
    return zip_by_position(sheet, short, order, "_position").drop("_position", "id")
