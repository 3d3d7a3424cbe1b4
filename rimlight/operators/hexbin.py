"""Hexagonal binning of shot locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimlight.functions import hexgrid
from rimlight.functions.hexgrid import BIN_WIDTH, CELL
from rimlight.functions.joins import join_null_safe
from rimlight.operators.zones import ZONE
from rimlight.session import cut_lineage

# A cell's key: the anchor of its lattice and its place on it.
HEX = ["x0", "y0", *CELL]


def with_hex_cell(
    df: DataFrame,
    x: str = "loc_x",
    y: str = "loc_y",
    width: float = BIN_WIDTH,
    by: Sequence[str] = (),
    origin: tuple[float, float] | None = None,
) -> DataFrame:
    """``df`` with its lattice anchor (x0, y0) and cell (lat, j, i); rows without a location go.

    The lattice is anchored to the lower bounds of the data: of each ``by`` group, or of all rows.
    ``origin`` fixes the anchor instead, for cells that compare across selections.

    The anchors of groups are written and joined back on the group, null groups included: Spark sends
    them out if their files are small, else adaptive plans split the skewed partitions of the join.
    """
    located = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    lows = [
        hexgrid.lower_bound(F.min(x), width).alias("x0"),
        hexgrid.lower_bound(F.min(y), width).alias("y0"),
    ]
    if origin is not None:
        anchored = located.withColumns({"x0": F.lit(float(origin[0])), "y0": F.lit(float(origin[1]))})
    elif by:
        anchors = cut_lineage(located.groupBy(*by).agg(*lows))
        anchored = join_null_safe(located, anchors, by, "inner")
    else:
        low = located.agg(F.struct(*lows)).scalar()
        anchored = located.withColumn("_low", low).select(*df.columns, "_low.x0", "_low.y0")
    cell = hexgrid.hex_cell(F.col(x), F.col(y), F.col("x0"), F.col("y0"), width)
    return anchored.withColumn("_cell", cell).select(
        *df.columns, "x0", "y0", *[F.col(f"_cell.{c}").alias(c) for c in CELL]
    )


def hex_zone_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of attempts, makes and points per (cell, zone), from columns of these names."""
    return cells.groupBy(*by, *HEX, *ZONE).agg(
        *[F.sum(c).alias(c) for c in ("attempts", "made", "points")]
    )


def hex_stats(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cell: attempts, FG%, points, points per shot and the zone most attempts fall in.

    Equal zones resolve to the first by (zone_range, name_zone). Shots are shuffled once, already
    combined to (cell, zone) rows; the window then runs over the few zones of a cell.
    """
    counts = hex_zone_counts(cells, by)
    cell = Window.partitionBy(*by, *HEX)
    first = cell.orderBy(
        F.col("attempts").desc(), *[F.col(c).asc_nulls_last() for c in ZONE]
    )
    attempts, made, points = (F.sum(c).over(cell) for c in ("attempts", "made", "points"))
    return (
        counts.select(
            *by,
            *HEX,
            *ZONE,
            attempts.alias("hex_attempts"),
            (made / attempts).alias("hex_pct"),
            points.alias("hex_points_scored"),
            (points / attempts).alias("hex_points_per_shot"),
            F.row_number().over(first).alias("_rank"),
        )
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def dominant_zone(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cell, the zone most attempts fall in."""
    return hex_stats(cells, by).select(*by, *HEX, *ZONE)


def hex_vertices(stats: DataFrame, width: float = BIN_WIDTH) -> DataFrame:
    """One row per (cell, corner): centre and corner coordinates."""
    cx, cy = hexgrid.hex_center(*[F.col(c) for c in [*CELL, "x0", "y0"]], width)
    return (
        stats.withColumns({"center_x": cx, "center_y": cy})
        .select("*", F.posexplode(hexgrid.corner_array(width)).alias("corner", "_offset"))
        .withColumns({"x": F.col("center_x") + F.col("_offset.dx"), "y": F.col("center_y") + F.col("_offset.dy")})
        .drop("_offset")
    )
