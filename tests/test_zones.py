import pytest
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.zones import base_zone_stats, zone_comparison, zone_stats
from rimlight.plans import zone_table
from rimlight.sources import tables

ROWS = [
    # shooter, season, streak, made, type, zone_basic, zone_range, name_zone
    ("Ann", "2016-17", "1 Make", True, "2PT Field Goal", "Mid-Range", "8-16 ft.", "Center"),
    ("Ann", "2016-17", "1 Make", False, "2PT Field Goal", "Mid-Range", "8-16 ft.", "Center"),
    ("Ann", "2016-17", "1 Make", True, "3PT Field Goal", "Above the Break 3", "24+ ft.", "Center"),
    ("Ann", "2016-17", "1 Miss", False, "3PT Field Goal", "Above the Break 3", "24+ ft.", "Center"),
    ("Ann", "2017-18", "1 Make", True, "2PT Field Goal", "Mid-Range", "8-16 ft.", "Center"),
    ("Ann", "2016-17", "1 Make", True, "2PT Field Goal", "Mid-Range", "16-24 ft.", None),
    ("Bob", "2016-17", "1 Make", False, "2PT Field Goal", "Mid-Range", "8-16 ft.", "Center"),
    ("Bob", "2016-17", "1 Make", True, "2PT Field Goal", None, "16-24 ft.", None),
    ("Bob", "2016-17", "1 Make", True, "2PT Field Goal", "Restricted Area", "Less Than 8 ft.", "Center"),
    ("O'Neal", "2016-17", "1 Make", True, None, "Backcourt", "Back Court Shot", "Back Court"),
    ("Ann", "2016-17", "1 Make", None, "2PT Field Goal", "Mid-Range", "8-16 ft.", "Center"),
]


@pytest.fixture(scope="module")
def shots(spark):
    rows = [(s, y, k, 0.0, 0.0, 1.0, m, True, t, b, r, z) for s, y, k, m, t, b, r, z in ROWS]
    return spark.createDataFrame(rows, schemas.STREAK_SHOTS).cache()


def test_league_table_of_one_player(shots):
    table = zone_table(shots, "1 Make", "Ann", ["2016-17"])
    assert table.columns == ["zone_range", "name_zone", "zone_pct", "zone_points_per_shot", "league_pps"]
    # Near to far; the null zone matches the null zone.
    assert [tuple(r) for r in table.collect()] == [
        ("8-16 ft.", "Center", 0.5, 1.0, 0.67),
        ("16-24 ft.", None, 1.0, 2.0, 2.0),
        ("24+ ft.", "Center", 1.0, 3.0, 3.0),
    ]


def test_self_table_of_one_player(shots):
    table = zone_table(shots, "1 Make", "Ann", ["2016-17"], scope="self")
    assert [tuple(r) for r in table.collect()] == [
        ("8-16 ft.", "Center", 0.5, 1.0, 0.0),
        ("16-24 ft.", None, 1.0, 2.0, 0.0),
        ("24+ ft.", "Center", 1.0, 3.0, 0.5),
    ]


@pytest.mark.parametrize("scope", ["league", "self"])
@pytest.mark.parametrize("others_only", [False, True])
def test_tables_of_all_players_hold_those_of_each(shots, scope, others_only):
    every = zone_table(shots, "1 Make", scope=scope, others_only=others_only).collect()
    for player in ("Ann", "Bob", "O'Neal"):
        one = zone_table(shots, "1 Make", player, scope=scope, others_only=others_only).collect()
        assert sorted(map(repr, (tuple(r) for r in one))) == sorted(
            repr(tuple(r)[1:]) for r in every if r.shooter == player
        )


def test_league_without_the_player(shots):
    table = zone_table(shots, "1 Make", "Ann", ["2016-17"], others_only=True)
    assert [r.league_pps for r in table.collect()] == [0.0, 2.0, None]


def test_all_seasons(shots):
    assert zone_table(shots, "1 Make", "Ann").first().zone_pct == 0.67


def test_no_shots_give_no_rows(shots):
    assert zone_table(shots, "3+ Makes", "Ann").collect() == []


def test_unknown_value_gives_unknown_points(shots):
    stats = {r.zone_range: r for r in zone_stats(shots).collect()}
    assert stats["Back Court Shot"].zone_points_per_shot is None
    assert stats["Back Court Shot"].zone_pct == 1.0
    assert stats["8-16 ft."].zone_attempts == 4


def test_base_values_come_from_the_zone(shots):
    base = {r.zone_range: r for r in base_zone_stats(shots).collect()}
    assert base["24+ ft."].league_pps == 1.5
    assert base["Back Court Shot"].league_pps == 3.0
    assert base["16-24 ft."].league_pps == 2.0


def test_attempts_add_up(shots):
    compared = zone_comparison(shots, "1 Make")
    total = compared.agg(F.sum("zone_attempts")).first()[0]
    assert total == shots.where("streak_col = '1 Make' and is_shot_made is not null").count()


def test_scans(shots):
    assert tables.player_streak_shots(shots, "O'Neal", ["2016-17", "2017-18"], "1 Make").count() == 1
    assert tables.league_streak_shots(shots, None, "1 Make").count() == 10
    assert tables.player_base_shots(shots, "Ann", ["2017-18"]).count() == 1
    assert tables.selector_values(shots).count() == 4
    assert {r[0] for r in tables.selector_choices(tables.selector_values(shots), "shooter").collect()} == {
        "Ann", "Bob", "O'Neal",
    }
    diagnostics = {r.shooter: (r.shot_rows, r.unknown_rows) for r in tables.result_diagnostics(shots, "shooter").collect()}
    assert diagnostics["Ann"] == (7, 1)


def test_round_last(spark):
    rows = [("A", "s", "1 Make" if i < 3 else "x", 0.0, 0.0, 1.0, i % 2 == 0, True, "2PT", "Z", "8-16", "C") for i in range(7)]
    shots = spark.createDataFrame(rows, schemas.STREAK_SHOTS)
    assert zone_table(shots, "1 Make", "A", scope="self").first().streak_diff == pytest.approx(0.67 - 0.57)
    assert zone_table(shots, "1 Make", "A", scope="self", round_last=True).first().streak_diff == 0.1


def test_unknown_scope(shots):
    with pytest.raises(ValueError):
        zone_table(shots, "1 Make", "Ann", scope="team")
