"""Rows and assets of stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.functions import markup


def page_rows(
    pages: DataFrame,
    page: str,
    text: str,
    row_pattern: str,
    cell_pattern: str,
    width: int | None = None,
) -> DataFrame:
    """One row per match of ``row_pattern``, its cells in columns c0, c1, ...

    Group 1 of the patterns is the row and the cell. A short row ends in NULLs,
    repeated header rows stay, a page without rows gives none. Each page is cut
    up where it is read; nothing is shuffled. The columns are as many as the widest row
    has cells; with ``width`` they are so many, and a wider row is an error.
    """
    rows = F.regexp_extract_all(F.col(text), F.lit(row_pattern), F.lit(1))
    found = pages.select(page, F.posexplode(rows).alias("row_idx", "_row"))
    cells = F.regexp_extract_all(F.col("_row"), F.lit(cell_pattern), F.lit(1))
    rows = found.select(page, "row_idx", cells.alias("_cells"))
    if width is None:
        width = rows.agg(F.max(F.size("_cells"))).collect()[0][0] or 0
    else:
        wide = F.raise_error(F.concat(F.lit(f"more than {width} cells: "), F.to_json("_cells")))
        fits = F.size("_cells") <= F.lit(width)
        rows = rows.withColumn("_cells", F.when(fits, F.col("_cells")).otherwise(wide))
    return rows.select(
        page,
        "row_idx",
        *[F.get("_cells", F.lit(position)).alias(f"c{position}") for position in range(width)],
    )


def page_assets(
    pages: DataFrame, page: str, text: str, tags: Sequence[str], only: Column | None = None
) -> DataFrame:
    """How often each page opens each of the tags, in any case; tags that do not occur are left out.

    ``only`` chooses pages, by number say, before anything is counted.
    """
    if only is not None:
        pages = pages.filter(only)
    counts = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                F.regexp_count(F.col(text), F.lit(rf"(?i)<{tag}[\s/>]")).cast("bigint").alias("n"),
            )
            for tag in tags
        ]
    )
    return pages.select(page, F.inline(counts)).filter("n > 0")


def page_grid(pages: DataFrame, page: str, text: str) -> DataFrame:
    """The rows of every table as a page lays them out: ``table_idx``, ``row_idx`` and ``cells``.

    A cell that spans columns or rows stands in every place that it covers, so places have the same
    column all the way down. Tables are numbered as they open; a table within a cell is a table of its
    own and gives that cell no text. References are decoded and white space becomes one
    blank. Each page is read where it lies; nothing is shuffled. NULL has no tables.
    """
    return pages.select(page, F.inline(markup.grids(F.col(text))))


def page_asset_list(
    pages: DataFrame,
    page: str,
    text: str,
    tags: Sequence[str] = ("img",),
    attributes: Sequence[str] = ("src", "width", "height"),
) -> DataFrame:
    """A row per asset of each page, in page order, with the wanted attributes as text.

    Tags in comments, scripts and other raw text are none. A missing attribute is NULL, one without
    a value is empty; of repeated ones the first counts. Nothing is shuffled.
    """
    found = pages.select(
        page, F.posexplode(markup.tags_of(F.col(text), tags)).alias("asset_idx", "_tag")
    )
    values = [
        markup.decoded(markup.attribute(F.col("_tag"), name)).alias(name) for name in attributes
    ]
    return found.select(page, "asset_idx", markup.tag_name(F.col("_tag")).alias("tag"), *values)
