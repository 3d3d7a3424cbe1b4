"""Season tables, the player dimension and the scans over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rimlight import schemas


def read_table(
    spark: SparkSession, source: str, schema: StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A stored table with a declared schema; ``fmt="jdbc"`` reads the table named ``source``."""
    if fmt == "jdbc":
        table = spark.read.format("jdbc").options(dbtable=source, **options).load()
        return table.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return spark.read.schema(schema).format(fmt).options(**options).load(source)


def read_shots(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, source, schemas.SHOTS, fmt, **options)


def read_streak_shots(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, source, schemas.STREAK_SHOTS, fmt, **options)


# Bytes of a row group of the season table: what a scan by shooter reads or skips.
ROW_GROUP_BYTES = 8 << 20


def write_streak_shots(
    shots: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """The labelled season table, a folder per season, sorted by shooter and streak within each file.

    A scan by season opens its folders only, and one by shooter skips most row groups by their
    minimum and maximum, or by their bloom filters where the name lies between.
    """
    balanced = shots.select(*schemas.STREAK_SHOTS.names).hint("rebalance", "slug_season")
    ordered = balanced.sortWithinPartitions("slug_season", "shooter", "streak_col")
    options = {"parquet.block.size": str(row_group_bytes), "parquet.bloom.filter.enabled#shooter": "true"}
    ordered.write.mode(mode).options(**options).partitionBy("slug_season").parquet(path)


def read_players(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """idPlayer and namePlayer of every player."""
    return read_table(spark, source, schemas.PLAYERS, fmt, **options).select("idPlayer", "namePlayer")


def active_players(players: DataFrame, since: int = 2014, name: str | None = None) -> DataFrame:
    """Picture address and name of players active after season ``since``, or of one of them."""
    found = players.where(F.col("yearSeasonLast") > since)
    if name is not None:
        found = found.where(F.col("namePlayer") == name)
    return found.select("urlPlayerHeadshot", "namePlayer")


def in_seasons(seasons: Iterable[str] | None) -> Column:
    """Membership of slug_season; ``None`` stands for all seasons."""
    return F.lit(True) if seasons is None else F.col("slug_season").isin(list(seasons))


def player_streak_shots(shots: DataFrame, player: str, seasons: Iterable[str] | None, streak: str) -> DataFrame:
    """One player's shots after one kind of streak."""
    return shots.where(
        (F.col("shooter") == player) & in_seasons(seasons) & (F.col("streak_col") == streak)
    ).select(
        "location_x",
        "location_y",
        "distance_shot",
        "is_shot_made",
        "is_shot_attempted",
        "type_shot",
        "zone_range",
        "name_zone",
    )


def league_streak_shots(shots: DataFrame, seasons: Iterable[str] | None, streak: str) -> DataFrame:
    """Everybody's shots after one kind of streak."""
    return shots.where(in_seasons(seasons) & (F.col("streak_col") == streak)).select(
        "is_shot_attempted", "is_shot_made", "zone_basic", "zone_range", "name_zone"
    )


def player_base_shots(shots: DataFrame, player: str, seasons: Iterable[str] | None) -> DataFrame:
    """One player's shots whatever the streak."""
    return shots.where((F.col("shooter") == player) & in_seasons(seasons))


def coverage_shots(enriched: DataFrame, streak: str) -> DataFrame:
    """Enriched shots after one kind of streak."""
    return enriched.where(F.col("streak_col") == streak).select(
        "shooter",
        "shooter_team_name",
        "streak_col",
        "type_shot",
        "zone_basic",
        "name_zone",
        "zone_range",
        "distance_shot",
        "is_shot_attempted",
        "is_shot_made",
        "closest_defender_distance_bin",
    )


def total_shots(enriched: DataFrame) -> DataFrame:
    """The columns the totals need, over all streaks."""
    return enriched.select("shooter", "closest_defender_distance_bin", "is_shot_attempted")


def selector_values(shots: DataFrame) -> DataFrame:
    """The (shooter, season) pairs to choose from."""
    return shots.select("shooter", "slug_season").distinct()


def selector_choices(selector: DataFrame, column: str) -> DataFrame:
    """Distinct values of one selector column."""
    return selector.select(column).distinct()


def known_results(shots: DataFrame) -> DataFrame:
    """Shots whose made and attempted flags are both known; only these enter the rates."""
    return shots.where(F.col("is_shot_made").isNotNull() & F.col("is_shot_attempted").isNotNull())


def result_diagnostics(shots: DataFrame, *keys: str) -> DataFrame:
    """Per key: rows, and rows that ``known_results`` leaves out."""
    unknown = F.col("is_shot_made").isNull() | F.col("is_shot_attempted").isNull()
    return shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shot_rows"), F.count_if(unknown).alias("unknown_rows")
    )
