"""The label repairs as functions that SQL text can call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trendline.functions.dates import weekly_cutoff
from trendline.functions.labels import (
    compact_date,
    join_range_label,
    strip_week_token,
    week_label_day,
)

# Name in SQL, type of the argument, expression.
FUNCTIONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "week_label_day": ("STRING", week_label_day),
    "compact_date": ("STRING", compact_date),
    "strip_week_token": ("STRING", strip_week_token),
    "join_range_label": ("STRING", join_range_label),
    "weekly_cutoff": ("DATE", weekly_cutoff),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Makes temporary SQL functions out of the column expressions; gives their names.

    Their bodies are the SQL text of the expressions, so Catalyst puts them in place of each call:
    no Python runs, and a filter on a call is optimised like the expression itself. They belong
    to the session; registering them again replaces them.
    """
    for name, (argument, expression) in FUNCTIONS.items():
        body = spark.range(0).select(F.lit(None).cast(argument).alias("label"))
        body = body.select(expression(F.col("label")).alias("result"))
        text = body._jdf.queryExecution().analyzed().expressions().head().child().sql()
        result = body.schema["result"].dataType.simpleString()
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(label {argument}) "
            f"RETURNS {result} RETURN {text}"
        )
    return list(FUNCTIONS)
