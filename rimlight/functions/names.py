"""Column naming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def snake_name(name: str) -> str:
    """``yearSeasonLast`` -> ``year_season_last``, ``FG % (Open)`` -> ``fg_percent_open``."""
    text = name.replace("%", " percent ").replace("#", " number ")
    text = re.sub(r"([a-z])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z0-9]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if text[:1].isdigit() or not text else text


def snake_case(df: DataFrame) -> DataFrame:
    """All column names in snake case; a repeated name gets ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for name in map(snake_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
