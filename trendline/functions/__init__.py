"""Column expressions and column-name rules."""

from trendline.functions.dates import parse_day, weekly_cutoff
from trendline.functions.labels import (
    compact_date,
    join_range_label,
    strip_week_token,
    week_label_day,
)
from trendline.functions.names import safe_column_names, safe_names

__all__ = [
    "compact_date",
    "join_range_label",
    "parse_day",
    "safe_column_names",
    "safe_names",
    "strip_week_token",
    "week_label_day",
    "weekly_cutoff",
]
