"""Pivot and union helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def pivot_wide(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    names: Sequence[str],
    measures: dict[str, Column],
    fill: float = 0,
) -> DataFrame:
    """One row per key and one ``<measure>_<name>`` column per measure and listed name.

    The names are listed by the caller: the columns do not depend on the data, and Spark need not
    scan it for them. Missing cells hold ``fill``.
    """
    wide = (
        df.groupBy(*keys)
        .pivot(names_from, list(names))
        .agg(*[column.alias(measure) for measure, column in measures.items()])
    )
    # Spark leaves the measure out of the name if there is only one.
    single = next(iter(measures)) if len(measures) == 1 else None
    pairs = [(n, m) for n in names for m in measures]
    renamed = wide.withColumnsRenamed(
        {(n if single else f"{n}_{m}"): f"{m}_{n.lower()}" for n, m in pairs}
    )
    return renamed.na.fill(fill, [f"{m}_{n.lower()}" for n, m in pairs]).select(
        *keys, *[f"{m}_{n.lower()}" for m in measures for n in names]
    )


def union_filled(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing from a frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
