"""Court geometry, shot values, coverage bins and zone ranks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths in feet, labels and patterns of the source data.
COURT_LENGTH = 94
COURT_WIDTH = 50
HALF_COURT = 47
BACKBOARD_OFFSET = 4
NECK_LENGTH = 0.5
HOOP_RADIUS = 0.75
HOOP_CENTER_Y = BACKBOARD_OFFSET + NECK_LENGTH + HOOP_RADIUS

BALL_ID = -1
BALL_NAME = "Ball"
MAX_BALL_DISTANCE = 1.75
TEAMMATE_DISTANCE = 300.0

THREE_POINT_TEXT = "3pt field goal"
THREE_POINT_PATTERN = "3PT"
THREE_POINT_ZONES = ["Above the Break 3", "Backcourt", "Left Corner 3", "Right Corner 3"]

# Lower edge in feet of each coverage bin, widest first.
COVERAGE_BINS = [(6, "Wide Open"), (4, "Open"), (2, "Tight"), (0, "Very Tight")]
COARSE_COVERAGE = {"Wide Open": "Open", "Very Tight": "Tight"}

# Regular expression -> typical distance; the first match counts, and "24+" also finds "16-24 ft.".
ZONE_RANKS = [("16-24", 18), ("24+", 24), ("8-16", 12), ("Back Court", 40), ("Less Than", 4)]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def game_key(game_id: str | Column) -> Column:
    """``"0021500001"`` -> 21500001: the two leading characters dropped, as a long."""
    return F.substring(_col(game_id), 3, 64).try_cast("bigint")


def fold_half_court(x: str | Column) -> Column:
    """x mirrored onto one half."""
    x = _col(x)
    return F.when(x > HALF_COURT, COURT_LENGTH - x).otherwise(x)


def turn_half_court(x: str | Column, y: str | Column) -> Column:
    """y of a point whose half is turned, not mirrored, onto the other."""
    return F.when(_col(x) > HALF_COURT, COURT_WIDTH - _col(y)).otherwise(_col(y))


def shot_game_clock(minutes: str | Column, seconds: str | Column) -> Column:
    """Seconds left in the quarter."""
    return _col(minutes) * 60 + _col(seconds)


def entity_name(player_id: str | Column, name: str | Column) -> Column:
    return F.when(_col(player_id) == BALL_ID, BALL_NAME).otherwise(_col(name))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def opponent_distance(
    same_team: Column, dist: Column, teammate_dist: float = TEAMMATE_DISTANCE
) -> Column:
    """Distance, or the far sentinel for a teammate of the shooter."""
    return F.when(same_team, F.lit(float(teammate_dist))).otherwise(dist)


def coverage_bin(dist: str | Column) -> Column:
    """Wide Open / Open / Tight / Very Tight; null for a null distance."""
    dist = _col(dist)
    expr = F
    for edge, label in COVERAGE_BINS:
        expr = expr.when(dist >= edge, F.lit(label))
    return expr


def coarse_coverage(label: str | Column) -> Column:
    """The four bins folded to Open and Tight."""
    label = _col(label)
    expr = F
    for fine, coarse in COARSE_COVERAGE.items():
        expr = expr.when(label == fine, F.lit(coarse))
    return expr.otherwise(label)


def court_x(location_x: str | Column) -> Column:
    """Tenths of a foot to feet."""
    return _col(location_x) / F.lit(10.0)


def court_y(location_y: str | Column) -> Column:
    """Tenths of a foot from the hoop to feet from the baseline."""
    return _col(location_y) / F.lit(10.0) + F.lit(HOOP_CENTER_Y)


def flag(value: str | Column) -> Column:
    """Boolean to 0/1."""
    return _col(value).cast("int")


def made_label(made: str | Column) -> Column:
    made = _col(made)
    return F.when(made, F.lit("made")).when(~made, F.lit("missed"))


def value_by_type(type_shot: str | Column) -> Column:
    """3 or 2 points by the shot's type text; null for a null type."""
    text = _col(type_shot)
    return F.when(F.lower(text) == THREE_POINT_TEXT, 3).when(text.isNotNull(), 2)


def value_by_zone(zone_basic: str | Column) -> Column:
    """3 or 2 points by the shot's zone; 2 for a null zone."""
    return F.when(F.coalesce(_col(zone_basic).isin(THREE_POINT_ZONES), F.lit(False)), 3).otherwise(2)


def is_three(type_shot: str | Column) -> Column:
    return _col(type_shot).rlike(THREE_POINT_PATTERN)


def zone_rank(zone_range: str | Column) -> Column:
    """Typical distance of a zone range for sorting; null if no pattern is found."""
    text = _col(zone_range)
    expr = F
    for pattern, rank in ZONE_RANKS:
        expr = expr.when(text.rlike(pattern), F.lit(rank))
    return expr


def effective_fg(fgm: Column, threes: Column, fga: Column) -> Column:
    """(made + half the threes) / attempts; which threes count is up to the caller."""
    return F.try_divide(fgm.cast("double") + F.lit(0.5) * threes, fga.cast("double"))
