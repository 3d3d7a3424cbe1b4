"""Properties of the physical plans."""

import pytest

from rimlight import adapters, schemas
from rimlight.operators.hexbin import with_hex_cell
from rimlight.operators.tracking import ball_positions, half_court
from rimlight.plans import coverage_table, enrich_shots, hex_shot_chart, zone_table
from rimlight.queries import QUERIES
from rimlight.sources import tables, tracking
from rimlight.sources.tables import read_streak_shots

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    frames = {
        "streak_shots": schemas.STREAK_SHOTS,
        "tracking": schemas.TRACKING,
        "shots": schemas.SHOTS,
        "players": schemas.PLAYERS,
        "enriched": schemas.ENRICHED,
    }
    for name, schema in frames.items():
        if name == "enriched":
            tracking.write_enriched(spark.createDataFrame([], schema), str(root / name), mode="append")
        else:
            spark.createDataFrame([], schema).write.parquet(str(root / name))
    return root


@pytest.fixture(scope="module")
def streak_shots(spark, stored):
    return read_streak_shots(spark, str(stored / "streak_shots"))


def test_scan_filters_reach_the_file(streak_shots):
    text = plan(tables.player_streak_shots(streak_shots, "Ann", ["2016-17", "2017-18"], "1 Make"))
    pushed = text[text.index("PushedFilters") :]
    for part in ("EqualTo(shooter,Ann)", "In(slug_season, [2016-17,2017-18])", "EqualTo(streak_col,1 Make)"):
        assert part in pushed
    assert "yearSeasonLast" not in text


def test_season_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "by_season")
    shots = adapters.streak_shots(spark, SF)
    tables.write_streak_shots(shots, path)
    stored = read_streak_shots(spark, path)
    assert stored.count() == shots.count()
    seasons = ["2024-01-01", "2024-01-08"]
    text = plan(zone_table(stored, "1 Make", "7", seasons))
    assert "PartitionFilters: [slug_season" in text
    one, other = (zone_table(df, "1 Make", "7", seasons).collect() for df in (stored, shots))
    assert one == other != []


def test_zone_table_is_one_scan_and_one_aggregate_shuffle(streak_shots):
    for scope in ("league", "self"):
        text = plan(zone_table(streak_shots, "1 Make", "Ann", ["2016-17"], scope))
        physical = text[text.index("Physical Plan") :]
        assert physical.count("FileScan") == 1
        assert physical.count("Exchange hashpartitioning") == 1
        assert "location_x" not in physical.split("ReadSchema")[1]
    assert "EqualTo(streak_col,1 Make)" in plan(zone_table(streak_shots, "1 Make", "Ann", ["2016-17"]))


def test_coverage_table_is_one_scan_with_hash_aggregates_first(spark, stored):
    rows = tracking.read_enriched(spark, str(stored / "enriched"))
    text = plan(coverage_table(rows, "1 Make"))
    physical = text[text.index("Physical Plan") :]
    assert physical.count("FileScan") == 1
    assert physical.count("HashAggregate(keys=[shooter#") >= 2
    assert "Join" not in physical


def test_top_row_is_limited_before_the_shuffle(spark, stored):
    frames = half_court(tracking.read_tracking(spark, str(stored / "tracking")))
    physical = plan(ball_positions(frames))
    physical = physical[physical.index("Physical Plan") :]
    below = physical[physical.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below
    assert "EqualTo(player_id,-1)" in below


def test_enrichment_joins_are_equi_joins(spark, stored):
    enriched = enrich_shots(
        tracking.read_tracking(spark, str(stored / "tracking")),
        tables.read_shots(spark, str(stored / "shots")),
        tables.read_players(spark, str(stored / "players")),
    )
    text = plan(enriched)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "shot_clock" not in "".join(part.split("\n")[0] for part in text.split("ReadSchema")[1:])


def test_hex_plans_have_no_cross_join(streak_shots):
    for player in ("Ann", None):
        text = plan(hex_shot_chart(streak_shots, "1 Make", player, scope="self"))
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert "NestedLoop" not in plan(with_hex_cell(streak_shots, "location_x", "location_y"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ingest_games", "tracking_csv", "enriched_sink", "season_table_scan"}))
def test_queries_stay_in_the_jvm_without_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("NestedLoop", "Cartesian", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text
