"""Zone tables, coverage tables and percentiles from sums kept by batch instead of from all shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from rimlight.functions import court
from rimlight.operators.coverage import COVERAGE_KEYS, COVERAGE_SUMS, coverage_measures
from rimlight.operators.zones import SUM_KEYS, SUM_NAMES, zone_measures
from rimlight.sources.kept import add_sums, compact_sums, read_sums
from rimlight.sources.versions import GAME, add_version, compact, read_versions

SUMS, LATEST = "sums", "latest"


def _schema(keys: dict, measures: list[str]) -> StructType:
    return StructType([StructField(k, t) for k, t in keys.items()] + [StructField(m, LongType()) for m in measures])


_ZONES = _schema(dict.fromkeys(SUM_KEYS, StringType()), SUM_NAMES)
_COVERAGE = _schema(dict.fromkeys(COVERAGE_KEYS, StringType()), COVERAGE_SUMS)
_LATEST = _schema(
    {GAME: LongType(), **dict.fromkeys(["shooter", "streak_col", "shooter_team_name"], StringType())}, ["last_event"]
)
_COUNTS = _schema({"value": DoubleType()}, ["n_value"])


def keep_zones(path: str, batch: int, added: DataFrame, removed: DataFrame | None = None) -> None:
    """Keeps a batch's sums by shooter, season, streak and zone; ``removed`` are stored shots that no longer count,
    such as ``replaced_rows`` of a game sent again, or shots under the labels they had before."""
    add_sums(path, batch, {k: F.col(k) for k in SUM_KEYS}, zone_measures(), added, removed)


def kept_zones(spark: SparkSession, path: str) -> DataFrame:
    """What ``zone_comparison`` and ``zone_table`` take with ``summed``."""
    return read_sums(spark, path, _ZONES, SUM_KEYS)


def keep_coverage(path: str, batch: int, added: DataFrame, removed: DataFrame | None = None) -> None:
    """Keeps a batch's sums of enriched shots by shooter, streak and coverage, and each game's last event of a team.

    ``added`` and ``removed`` hold games whole: the last events of these games are replaced. Team names cannot be taken
    back from a maximum over all games, so they stay by game; all else has no game in its key.
    """
    coverage = court.coarse_coverage("closest_defender_distance_bin")
    keys = {k: coverage if k == "coverage" else F.col(k) for k in COVERAGE_KEYS}
    add_sums(f"{path}/{SUMS}", batch, keys, coverage_measures(), added, removed)
    games = added.select(GAME) if removed is None else added.select(GAME).unionByName(removed.select(GAME))
    last = added.groupBy(*_LATEST.names[:-1]).agg(F.max("event_id").alias("last_event"))
    add_version(last.select(*_LATEST.names), f"{path}/{LATEST}", games, batch)


def kept_coverage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sums and the last events, which ``coverage_table`` takes in place of the shots."""
    return (
        read_sums(spark, f"{path}/{SUMS}", _COVERAGE, COVERAGE_KEYS),
        read_versions(spark, f"{path}/{LATEST}", _LATEST),
    )


def keep_values(path: str, batch: int, column: str, added: DataFrame, removed: DataFrame | None = None) -> None:
    """Keeps how often each value of a numeric column occurs; null and NaN are left out."""
    value = F.col(column).cast("double")
    counts = (value.isNotNull() & ~F.isnan(value)).cast("int")
    add_sums(path, batch, {"value": value}, {"n_value": F.coalesce(counts, F.lit(0))}, added, removed)


def kept_values(spark: SparkSession, path: str) -> DataFrame:
    """(value, n_value), which ``breaks_of_counts`` takes."""
    return read_sums(spark, path, _COUNTS, ["value"])


def compact_kept(spark: SparkSession, zones: str | None = None, coverage: str | None = None, values: str | None = None) -> None:
    """The batches of the named stores made one, between two batches."""
    if zones is not None:
        compact_sums(spark, zones, _ZONES, SUM_KEYS)
    if coverage is not None:
        compact_sums(spark, f"{coverage}/{SUMS}", _COVERAGE, COVERAGE_KEYS)
        compact(spark, f"{coverage}/{LATEST}", _LATEST)
    if values is not None:
        compact_sums(spark, values, _COUNTS, ["value"])
