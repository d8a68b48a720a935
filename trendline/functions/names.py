"""Column names that every table format accepts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# Fixed value: the characters that table formats refuse in a column name.
UNSAFE_CHARACTERS = " ,;{}()\n\t="

_TO_UNDERSCORE = str.maketrans(dict.fromkeys(UNSAFE_CHARACTERS, "_"))


def safe_names(names: Iterable[str]) -> list[str]:
    """Lower-case each name, put ``_`` for unsafe characters, number repeats from 2."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = name.lower().translate(_TO_UNDERSCORE)
        candidate, repeat = base, 1
        while candidate in taken:
            repeat += 1
            candidate = f"{base}_{repeat}"
        taken.add(candidate)
        result.append(candidate)
    return result


def safe_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))
