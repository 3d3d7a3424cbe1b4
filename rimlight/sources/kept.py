"""Sums kept batch by batch: each batch adds what its rows bring and takes back what they replace.

A store is a table of versions whose rows are keys and exact integer sums, negative where a batch took more back than it
brought. A read adds the batches up, so it costs as much as the keys, not as the rows behind them; ``compact_sums`` makes
the batches one. A batch that runs again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rimlight.sources.versions import GAME, add_version, before_version, compact, read_versions


def add_sums(
    path: str,
    batch: int,
    keys: Mapping[str, Column],
    measures: Mapping[str, Column],
    added: DataFrame,
    removed: DataFrame | None = None,
) -> None:
    """Adds to the store the sums over ``added`` less those over ``removed``, in one aggregate.

    ``measures`` are whole numbers, the first of them 1 or 0: whether a row counts at all. Null counts as 0.
    """

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        values = [(F.coalesce(c.cast("bigint"), F.lit(0)) * sign).alias(n) for n, c in measures.items()]
        return rows.select(*[c.alias(k) for k, c in keys.items()], *values)

    rows = signed(added, 1)
    if removed is not None:
        rows = rows.unionByName(signed(removed, -1))
    sums = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])
    changed = F.lit(False)
    for n in measures:
        changed = changed | (F.col(n) != 0)
    add_version(sums.where(changed), path, None, batch)


def _merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    measures = [c for c in rows.columns if c not in keys]
    sums = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])
    return sums.where(F.col(measures[0]) > 0)


def read_sums(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """One row per key that has any rows left; ``schema`` names the keys and then the measures."""
    return _merged(read_versions(spark, path, schema), keys)


def compact_sums(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> None:
    """The batches made one, between two batches; ``versions.vacuum`` deletes the old ones."""
    compact(spark, path, schema, by=keys[0], merge=lambda rows: _merged(rows, keys))


def replaced_rows(spark: SparkSession, path: str, schema: StructType, batch: int, games: DataFrame) -> DataFrame:
    """The rows that a table of versions held of ``games`` (game_id) before ``batch``: what the batch takes back."""
    held = read_versions(spark, path, schema, before_version(spark, path, batch))
    sent = games.select(F.col(GAME).cast("bigint").alias("_sent")).distinct()
    return held.join(sent, held[GAME].cast("bigint").eqNullSafe(F.col("_sent")), "left_semi")
