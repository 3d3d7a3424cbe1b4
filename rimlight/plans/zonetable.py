"""Zone tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.functions import court
from rimlight.functions.numeric import round_to
from rimlight.operators.zones import ZONE, zone_comparison


def zone_table(
    shots: DataFrame,
    streak: str,
    player: str | None = None,
    seasons: Iterable[str] | None = None,
    scope: str = "league",
    others_only: bool = False,
    round_last: bool = False,
    summed: bool = False,
) -> DataFrame:
    """FG% and points per shot by zone after ``streak``.

    ``scope="league"``: zone_pct, zone_points_per_shot, league_pps. ``scope="self"``:
    streak_fg_percent, zone_points_per_shot, streak_diff (difference of the rounded rates to the
    player's base; ``round_last`` rounds the difference instead). ``others_only`` leaves the player
    out of the league. One player's table is sorted from near to far; without ``player`` the tables of
    all players come unsorted, with a ``shooter`` column. ``summed``: ``shots`` are ``kept_zones``.
    """
    zones = zone_comparison(shots, streak, player, seasons, scope, others_only, summed)
    by = [] if player is not None else ["shooter"]
    pct, pps = round_to(F.col("zone_pct"), 2), round_to(F.col("zone_points_per_shot"), 2)
    if scope == "league":
        measures = [
            pct.alias("zone_pct"),
            pps.alias("zone_points_per_shot"),
            round_to(F.col("league_pps"), 2).alias("league_pps"),
        ]
    else:
        diff = pct - round_to(F.col("league_pct"), 2)
        if round_last:
            diff = round_to(F.col("zone_pct") - F.col("league_pct"), 2)
        measures = [
            pct.alias("streak_fg_percent"),
            pps.alias("zone_points_per_shot"),
            diff.alias("streak_diff"),
        ]
    if player is not None:
        zones = zones.orderBy(
            court.zone_rank("zone_range").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ZONE]
        )
    return zones.select(*by, *ZONE, *measures)
