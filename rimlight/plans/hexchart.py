"""Hexagonal shot chart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimlight.functions import court, hexgrid
from rimlight.functions.joins import join_null_safe
from rimlight.functions.numeric import clamp
from rimlight.operators.hexbin import hex_stats, hex_vertices, with_hex_cell
from rimlight.operators.zones import ZONE, zone_comparison
from rimlight.session import cut_lineage
from rimlight.sources.tables import in_seasons, known_results

# Ranges of the colour scales.
DIFF_RANGE = (-0.15, 0.15)
PCT_RANGE = (0.2, 0.7)
POINTS_RANGE = (0.5, 1.5)


def chart_shots(
    shots: DataFrame, streak: str, player: str | None = None, seasons: Iterable[str] | None = None
) -> DataFrame:
    """The shots of a chart: attempts, makes and points per player, zone and location in feet.

    Equal locations are counted before the shuffle. Where locations are whole tenths of a foot, that
    bounds the rows of any player by the points of the court; nothing rests on it.
    """
    rows = shots.where(in_seasons(seasons) & (F.col("streak_col") == streak))
    if player is not None:
        rows = rows.where(F.col("shooter") == player)
    made = court.flag("is_shot_made")
    counts = known_results(rows).groupBy("shooter", *ZONE, "location_x", "location_y").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(made).alias("made"),
        F.sum(made * court.value_by_type("type_shot")).alias("points"),
    )
    return counts.select(
        "shooter",
        *ZONE,
        court.court_x("location_x").alias("loc_x"),
        court.court_y("location_y").alias("loc_y"),
        "attempts",
        "made",
        "points",
    )


def hex_shot_chart(
    shots: DataFrame,
    streak: str,
    player: str | None = None,
    seasons: Iterable[str] | None = None,
    scope: str = "league",
    width: float = hexgrid.BIN_WIDTH,
) -> DataFrame:
    """One row per corner of each hexagon, sized by attempts, with the FG% difference to the base.

    The lattice is anchored to each player's own shots. ``adj_x`` and ``adj_y`` are the corner
    drawn toward the centre by ``radius_factor``, x mirrored. No shots give no rows. Without
    ``player``, the charts of all players. ``shots`` is scanned once for the cells and once for the
    zones. The counted locations are written once, as the anchors and the cells both read them.
    """
    counted = cut_lineage(chart_shots(shots, streak, player, seasons))
    cells = with_hex_cell(counted, width=width, by=["shooter"])
    zones = zone_comparison(shots, streak, player, seasons, scope)
    keys = ZONE if player is not None else ["shooter", *ZONE]
    joined = join_null_safe(hex_stats(cells, ["shooter"]), zones, keys, "inner")
    # A player has no more cells than the lattice has on the court.
    most = F.max("hex_attempts").over(Window.partitionBy("shooter"))
    sized = joined.withColumn("radius_factor", hexgrid.radius_factor(F.col("hex_attempts"), most))
    corners = hex_vertices(sized, width)
    factor, cx, cy = F.col("radius_factor"), F.col("center_x"), F.col("center_y")
    return corners.withColumns(
        {
            "adj_x": -(cx + factor * (F.col("x") - cx)),
            "adj_y": cy + factor * (F.col("y") - cy),
            "bounded_fg_diff": clamp(F.col("zone_pct") - F.col("league_pct"), *DIFF_RANGE),
            "bounded_fg_pct": clamp(F.col("zone_pct"), *PCT_RANGE),
            "bounded_points_per_shot": clamp(F.col("zone_points_per_shot"), *POINTS_RANGE),
        }
    )
