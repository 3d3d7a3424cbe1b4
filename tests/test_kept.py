"""Tables from sums kept by batch against the same tables from the shots that count."""

import random

import pytest
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.percentiles import breaks_of_counts, percentile_breaks
from rimlight.plans import coverage_table, kept, zone_table
from rimlight.sources import versions
from rimlight.sources.kept import replaced_rows
from rimlight.streaming.streak_state import carry_streaks, correct_streaks, streak_fixes

STREAK = "1 Make"
SCHEMA = """game_id long, event_id long, shooter string, slug_season string, streak_col string, is_shot_made boolean,
    is_shot_attempted boolean, type_shot string, zone_basic string, zone_range string, name_zone string,
    shooter_team_name string, closest_defender_distance_bin string, distance_shot double"""


def game_rows(rng, game, batch):
    pick = rng.choice
    return [
        (
            game, e, pick(["a", "b", None]), pick(["s1", "s2"]), pick([STREAK, STREAK, "2 Misses", None]),
            pick([True, False, None]), pick([True, True, None]), pick(["2PT Field Goal", "3PT Field Goal", None]),
            pick(["Mid-Range", "Above the Break 3", None]), pick(["8-16 ft.", None]), pick(["Center", "Left Side"]),
            f"team {batch % 2}", pick(["Wide Open", "Open", "Tight", "Very Tight", None]),
            pick([1.0, 2.5, None, float("nan"), -0.0, 7.25]),
        )
        for e in range(rng.randrange(1, 9))
    ]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Five batches of games, most of them sent more than once; the third runs twice, two are made one."""
    rng, root, model = random.Random(11), f"file://{tmp_path_factory.mktemp('kept')}", {}
    for batch in range(5):
        sent = {g: game_rows(rng, g, batch) for g in rng.sample([*range(7), None], 4)}
        model |= sent
        rows = spark.createDataFrame([r for game in sent.values() for r in game], SCHEMA)
        if batch == 4:
            kept.compact_kept(spark, zones=f"{root}/zones", coverage=f"{root}/coverage", values=f"{root}/values")
        for _ in range(2 if batch == 2 else 1):
            removed = replaced_rows(spark, f"{root}/shots", rows.schema, batch, rows)
            kept.keep_zones(f"{root}/zones", batch, rows, removed)
            kept.keep_coverage(f"{root}/coverage", batch, rows, removed)
            kept.keep_values(f"{root}/values", batch, "distance_shot", rows, removed)
            versions.add_version(rows, f"{root}/shots", rows, batch)
    shots = spark.createDataFrame([r for game in model.values() for r in game], SCHEMA).cache()
    return root, shots


def as_text(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"scope": "self"},
        {"others_only": True, "seasons": ["s1"]},
        {"player": "a", "seasons": ["s2"]},
        {"player": "b", "scope": "self", "round_last": True},
    ],
)
def test_zone_tables(spark, store, options):
    root, shots = store
    expected = as_text(zone_table(shots, STREAK, **options))
    assert expected and as_text(zone_table(kept.kept_zones(spark, f"{root}/zones"), STREAK, **options, summed=True)) == expected


@pytest.mark.parametrize("options", [{}, {"made_threes": True, "fill": None}])
def test_coverage_tables(spark, store, options):
    root, shots = store
    table = coverage_table(kept.kept_coverage(spark, f"{root}/coverage"), STREAK, **options)
    expected = as_text(coverage_table(shots, STREAK, **options))
    assert expected and as_text(table) == expected
    assert table.columns == coverage_table(shots, STREAK).columns


def test_percentiles(spark, store):
    root, shots = store
    counts = kept.kept_values(spark, f"{root}/values")
    assert as_text(breaks_of_counts(counts, 7)) == as_text(percentile_breaks(shots, "distance_shot", 7))


def test_all_taken_back_is_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/zones"
    rows = spark.createDataFrame(game_rows(random.Random(1), 1, 0), SCHEMA)
    kept.keep_zones(path, 0, rows)
    kept.keep_zones(path, 1, rows.limit(0), rows)
    assert kept.kept_zones(spark, path).count() == 0
    kept.compact_kept(spark, zones=path)
    assert versions.vacuum(spark, path) == [0, 1]
    assert zone_table(kept.kept_zones(spark, path), STREAK, summed=True).count() == 0


def test_read_costs_the_keys_not_the_rows(spark, tmp_path):
    path = f"file://{tmp_path}/zones"
    rows = spark.createDataFrame(game_rows(random.Random(1), 1, 0), SCHEMA)
    known = rows.where("is_shot_made is not null and is_shot_attempted is not null")
    for batch in range(2):
        kept.keep_zones(path, batch, rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(500)))))
    keys = known.select("shooter", "slug_season", "streak_col", "zone_range", "name_zone").distinct().count()
    assert spark.read.parquet(f"{path}/data").count() == 2 * keys
    assert kept.kept_zones(spark, path).agg(F.sum("rows")).collect()[0][0] == 1000 * known.count()


def test_labels_that_a_late_game_changes_move_their_sums(spark, tmp_path):
    root, rng = f"file://{tmp_path}", random.Random(4)
    schema = None
    for batch, games in enumerate([[1, 3, 5], [2, 4], [1]]):
        rows = [r for g in games for r in game_rows(rng, g, batch)]
        shots = spark.createDataFrame(rows, SCHEMA).drop("streak_col")
        labelled = carry_streaks(shots, f"{root}/state", batch)
        schema = schema or labelled.schema
        held = versions.read_versions(spark, f"{root}/shots", schema, versions.before_version(spark, f"{root}/shots", batch))
        removed = replaced_rows(spark, f"{root}/shots", schema, batch, shots)
        # shots of other games under their labels so far, and under those of now
        changed = streak_fixes(spark, f"{root}/state", batch)
        moved = held.join(changed.withColumnRenamed("streak_col", "_new"), ["game_id", "event_id"])
        before = correct_streaks(moved.select(*schema.names), f"{root}/state", upto=batch - 1)
        after = moved.withColumn("streak_col", F.col("_new")).select(*schema.names)
        removed = correct_streaks(removed, f"{root}/state", upto=batch - 1)
        kept.keep_zones(f"{root}/zones", batch, labelled.unionByName(after), removed.unionByName(before))
        versions.add_version(labelled, f"{root}/shots", shots, batch)
    now = correct_streaks(versions.read_versions(spark, f"{root}/shots", schema), f"{root}/state")
    assert schema is not None and set(schema.names) >= set(schemas.STREAK_SHOTS.names) - {"location_x", "location_y"}
    for streak in ("1 Make", "1 Miss"):
        got = zone_table(kept.kept_zones(spark, f"{root}/zones"), streak, scope="self", summed=True)
        assert as_text(got) == as_text(zone_table(now, streak, scope="self"))
