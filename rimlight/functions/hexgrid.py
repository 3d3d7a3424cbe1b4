"""Hexagonal lattice in closed form (Carr, Littlefield, Nicholson and Littlefield 1987).

A hexagonal lattice is two interleaved rectangular ones. In coordinates scaled by the bin width and
sqrt(3) bin widths, each point has one candidate centre on either; the nearer one is its cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rimlight.functions.numeric import ceil_multiple, floor_multiple

# Fixed values.
BIN_WIDTH = 1.5
BOUND_SLACK = 1e-6
MIN_RADIUS = 0.25

CELL = ["lat", "j", "i"]


def lower_bound(min_value: Column, width: float = BIN_WIDTH) -> Column:
    return floor_multiple(min_value, width) - F.lit(BOUND_SLACK)


def upper_bound(max_value: Column, width: float = BIN_WIDTH) -> Column:
    return ceil_multiple(max_value, width) + F.lit(BOUND_SLACK)


def _lattice(x: Column, y: Column, x0: Column, y0: Column, width: float):
    u = (x - x0) / F.lit(width)
    v = (y - y0) / F.lit(width * math.sqrt(3))
    near_j, near_i = F.floor(u + F.lit(0.5)), F.floor(v + F.lit(0.5))
    half_j, half_i = F.floor(u), F.floor(v)

    def metric(j: Column, i: Column, shift: float) -> Column:
        du, dv = u - j - F.lit(shift), v - i - F.lit(shift)
        return du * du + F.lit(3.0) * dv * dv

    on_first = metric(near_j, near_i, 0.0) <= metric(half_j, half_i, 0.5)
    return on_first, (near_j, near_i), (half_j, half_i)


def hex_cell(x: Column, y: Column, x0: Column, y0: Column, width: float = BIN_WIDTH) -> Column:
    """struct<lat int, j bigint, i bigint>: the cell of a point; (x0, y0) anchors the lattice."""
    on_first, first, second = _lattice(x, y, x0, y0, width)
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.when(on_first, F.struct(F.lit(0).alias("lat"), first[0].alias("j"), first[1].alias("i"))).otherwise(
            F.struct(F.lit(1).alias("lat"), second[0].alias("j"), second[1].alias("i"))
        ),
    )


def hex_center(lat: Column, j: Column, i: Column, x0: Column, y0: Column, width: float = BIN_WIDTH):
    """(x, y) of a cell's centre."""
    half = lat / F.lit(2.0)
    return x0 + F.lit(width) * (j + half), y0 + F.lit(width * math.sqrt(3)) * (i + half)


def corner_offsets(width: float = BIN_WIDTH) -> list[tuple[float, float]]:
    """The six corners of a hexagon relative to its centre, going round."""
    dx, dy = width / 2, width / (2 * math.sqrt(3))
    return [(dx, dy), (0.0, 2 * dy), (-dx, dy), (-dx, -dy), (0.0, -2 * dy), (dx, -dy)]


def corner_array(width: float = BIN_WIDTH) -> Column:
    return F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in corner_offsets(width)]
    )


def radius_factor(attempts: Column, most: Column) -> Column:
    """Log-scaled size in [MIN_RADIUS, 1]; 1 for the busiest cell."""
    return F.lit(MIN_RADIUS) + F.lit(1 - MIN_RADIUS) * F.log(attempts + 1) / F.log(most + 1)
