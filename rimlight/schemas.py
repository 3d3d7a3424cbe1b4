"""Declared input and output schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


_LONG, _INT, _DBL, _STR, _BOOL = LongType(), IntegerType(), DoubleType(), StringType(), BooleanType()

CORRUPT = "_corrupt_record"

# Place of a row's first event in its document, where documents are cut.
FIRST_EVENT = "first_event"

# A moment mixes numbers, nulls and an entity list, so its elements are read as raw text.
EVENTS = ArrayType(_struct(eventId=_STR, moments=ArrayType(ArrayType(_STR))))
ENTITIES = ArrayType(ArrayType(_DBL))

GAME_DOCUMENT = _struct(events=EVENTS, **{CORRUPT: _STR})
GAME_LINE = _struct(gameid=_STR, events=EVENTS, **{CORRUPT: _STR})

# Position of a row in its log: event, moment in the event, entity in the moment.
ORDINALS = ["event_pos", "moment_pos", "entity_pos"]

TRACKING = _struct(
    team_id=_LONG,
    player_id=_LONG,
    x_loc=_DBL,
    y_loc=_DBL,
    radius=_DBL,
    game_clock=_DBL,
    shot_clock=_DBL,
    quarter=_INT,
    game_id=_STR,
    event_id=_LONG,
    event_pos=_INT,
    moment_pos=_INT,
    entity_pos=_INT,
)

# Tracking rows as ingested, among them one for each document that could not be flattened.
MARKED_TRACKING = StructType([*_struct(source_file=_STR, problem=_STR).fields, *TRACKING.fields])

# One row per (game_id, event_id).
SHOTS = _struct(
    game_id=_STR,
    event_id=_LONG,
    name_player=_STR,
    name_team=_STR,
    minutes_remaining=_INT,
    seconds_remaining=_INT,
    type_event=_STR,
    type_action=_STR,
    type_shot=_STR,
    zone_basic=_STR,
    name_zone=_STR,
    zone_range=_STR,
    distance_shot=_DBL,
    is_shot_attempted=_BOOL,
    is_shot_made=_BOOL,
    streak_col=_STR,
)

STREAK_SHOTS = _struct(
    shooter=_STR,
    slug_season=_STR,
    streak_col=_STR,
    location_x=_DBL,
    location_y=_DBL,
    distance_shot=_DBL,
    is_shot_made=_BOOL,
    is_shot_attempted=_BOOL,
    type_shot=_STR,
    zone_basic=_STR,
    zone_range=_STR,
    name_zone=_STR,
)

PLAYERS = _struct(idPlayer=_LONG, namePlayer=_STR, yearSeasonLast=_INT, urlPlayerHeadshot=_STR)

SELECTOR = _struct(shooter=_STR, slug_season=_STR)

ENRICHED = _struct(
    game_id=_LONG,
    event_id=_LONG,
    streak_col=_STR,
    shooter=_STR,
    shooter_team_name=_STR,
    game_clock=_DBL,
    type_action=_STR,
    type_shot=_STR,
    zone_basic=_STR,
    name_zone=_STR,
    zone_range=_STR,
    distance_shot=_DBL,
    is_shot_attempted=_BOOL,
    is_shot_made=_BOOL,
    name_player=_STR,
    distance_to_shooter=_DBL,
    closest_defender_distance_bin=_STR,
)
