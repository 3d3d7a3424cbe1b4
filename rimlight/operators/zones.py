"""Shooting by zone: rates per zone, and their comparison with the league or the player's base."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import court
from rimlight.functions.joins import join_null_safe
from rimlight.functions.numeric import ratio
from rimlight.session import cut_lineage
from rimlight.sources.tables import in_seasons, known_results

ZONE = ["zone_range", "name_zone"]


# What sums kept by batch (``sources.kept``) are keyed by.
SUM_KEYS = ["shooter", "slug_season", "streak_col", *ZONE]
SUM_NAMES = ["rows", "made", "attempts", "typed", "type_points", "points"]


def zone_measures() -> dict[str, Column]:
    """What a shot with a known result adds to the sums, all whole numbers; 0 for any other shot where kept."""
    made, points = court.flag("is_shot_made"), court.value_by_type("type_shot")
    known = F.col("is_shot_made").isNotNull() & F.col("is_shot_attempted").isNotNull()
    values = [
        F.lit(1),
        made,
        court.flag("is_shot_attempted"),
        points.isNotNull().cast("int"),
        made * points,
        made * court.value_by_zone("zone_basic"),
    ]
    return {name: F.when(known, value) for name, value in zip(SUM_NAMES, values, strict=True)}


def _parts(shots: DataFrame, summed: bool) -> tuple[DataFrame, dict[str, Column]]:
    """The rows to add up and their measures: shots with a known result, or sums kept of them."""
    return (shots, {n: F.col(n) for n in SUM_NAMES}) if summed else (known_results(shots), zone_measures())


def _streak_sums(measures: dict[str, Column], chosen: Column) -> list[Column]:
    """Attempts, makes and points of the chosen rows; points are null if any of them has no type."""

    def total(name: str) -> Column:
        return F.sum(F.when(chosen, measures[name]))

    whole = F.coalesce(total("typed") == total("rows"), F.lit(True))
    return [
        F.coalesce(total("rows"), F.lit(0)).alias("zone_attempts"),
        total("made").alias("zone_made"),
        F.when(whole, F.coalesce(total("type_points"), F.lit(0))).alias("zone_points_scored"),
    ]


BASE_SUMS = ["rows", "made", "attempts", "points"]


def _base_sums(measures: dict[str, Column], chosen: Column | None = None) -> list[Column]:
    return [
        F.sum(measures[name] if chosen is None else F.when(chosen, measures[name])).alias(f"base_{name}")
        for name in BASE_SUMS
    ]


def _streak_rates() -> list[Column]:
    attempts = F.col("zone_attempts")
    return [
        attempts,
        ratio(F.col("zone_made"), attempts).alias("zone_pct"),
        F.col("zone_points_scored"),
        ratio(F.col("zone_points_scored"), attempts).alias("zone_points_per_shot"),
    ]


def _base_rates() -> list[Column]:
    return [
        ratio(F.col("base_made"), F.col("base_attempts")).alias("league_pct"),
        ratio(F.col("base_points"), F.col("base_rows")).alias("league_pps"),
    ]


def zone_stats(shots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempts, FG%, points and points per shot by zone; points by the shot's type text."""
    rows, measures = _parts(shots, False)
    sums = rows.groupBy(*by, *ZONE).agg(*_streak_sums(measures, F.lit(True)))
    return sums.select(*by, *ZONE, *_streak_rates())


def base_zone_stats(shots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """league_pct = made / attempted and league_pps by zone; points by the shot's zone."""
    rows, measures = _parts(shots, False)
    sums = rows.groupBy(*by, *ZONE).agg(*_base_sums(measures))
    return sums.select(*by, *ZONE, *_base_rates())


def zone_comparison(
    shots: DataFrame,
    streak: str,
    player: str | None = None,
    seasons: Iterable[str] | None = None,
    scope: str = "league",
    others_only: bool = False,
    summed: bool = False,
) -> DataFrame:
    """Zone rates after ``streak`` next to the base rates.

    ``scope="league"``: the base is everybody's shots after the same streak (the player's own
    included; ``others_only`` leaves them out). ``scope="self"``: the player's shots whatever the
    streak. Without ``player`` the rows of all players are given, with a ``shooter`` column.

    The streak shots are a subset of the base shots, so both come out of one scan and one shuffle.
    Only the all-player league table joins: its rows, down to one per (shooter, zone), are written to
    the shared folder and read twice. ``summed``: ``shots`` are sums kept by batch (``plans.kept``).
    """
    rows, measures = _parts(shots.where(in_seasons(seasons)), summed)
    after = F.col("streak_col") == streak
    by = [] if player is not None else ["shooter"]
    base = [f"base_{c}" for c in BASE_SUMS]

    if scope == "self":
        if player is not None:
            rows = rows.where(F.col("shooter") == player)
        sums = rows.groupBy(*by, *ZONE).agg(*_streak_sums(measures, after), *_base_sums(measures))
    elif scope == "league" and player is not None:
        own = F.col("shooter") == player
        others = ~F.coalesce(own, F.lit(False)) if others_only else None
        sums = rows.where(after).groupBy(*ZONE).agg(*_streak_sums(measures, own), *_base_sums(measures, others))
    elif scope == "league":
        mine = cut_lineage(
            rows.where(after).groupBy(*by, *ZONE).agg(*_streak_sums(measures, F.lit(True)), *_base_sums(measures))
        )
        league = mine.groupBy(*ZONE).agg(*[F.sum(c).alias(f"all_{c}") for c in base])
        own = F.col if others_only else lambda c: F.lit(0)
        sums = join_null_safe(mine, league, ZONE, "left").withColumns(
            {c: F.col(f"all_{c}") - own(c) for c in base}
        )
    else:
        raise ValueError(f"unknown scope {scope!r}")

    return sums.where(F.col("zone_attempts") > 0).select(
        *by,
        *ZONE,
        *_streak_rates(),
        *_base_rates(),
    )
