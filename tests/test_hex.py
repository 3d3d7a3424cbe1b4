import math
import random

import pytest
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.hexbin import HEX, hex_stats, hex_vertices, with_hex_cell
from rimlight.plans import hex_shot_chart

POINT = "p string, loc_x double, loc_y double, attempts int, made int, points int, zone_range string, name_zone string"


def points(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [
        (rng.choice("aab"), rng.uniform(-25, 25), rng.uniform(0, 47), 1, rng.randrange(2), 2,
         rng.choice(["near", "far", None]), rng.choice(["L", "R"]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, POINT).cache()


def centre(r, lat, j, i):
    return r.x0 + 1.5 * (j + lat / 2), r.y0 + 1.5 * math.sqrt(3) * (i + lat / 2)


@pytest.mark.parametrize("by", [(), ("p",)])
def test_no_other_centre_is_nearer(spark, by):
    for r in with_hex_cell(points(spark), by=by).collect():
        own = math.dist(centre(r, r.lat, r.j, r.i), (r.loc_x, r.loc_y))
        others = [
            math.dist(centre(r, lat, r.j + dj, r.i + di), (r.loc_x, r.loc_y))
            for lat in (0, 1)
            for dj in (-1, 0, 1)
            for di in (-1, 0, 1)
        ]
        assert own <= min(others) + 1e-9


def test_anchor_is_below_the_data(spark):
    df = points(spark)
    low = df.agg(F.min("loc_x"), F.min("loc_y")).first()
    anchor = with_hex_cell(df).select("x0", "y0").distinct().collect()
    assert anchor == [tuple(math.floor(v / 1.5) * 1.5 - 1e-6 for v in low)]


def test_groups_have_anchors_of_their_own(spark):
    df = points(spark)
    together = {(r.p, r.x0, r.y0, r.lat, r.j, r.i) for r in with_hex_cell(df, by=["p"]).collect()}
    apart = set()
    for p in "ab":
        alone = with_hex_cell(df.where(F.col("p") == p))
        apart |= {(r.p, r.x0, r.y0, r.lat, r.j, r.i) for r in alone.collect()}
    assert together == apart


def test_rows_of_a_null_group_stay(spark):
    df = spark.createDataFrame([(p, 0.1 * k, 0.2 * k, 1, 1, 2, "n", "C") for k, p in enumerate(["a", None, None])], POINT)
    got = {(r.p, r.lat, r.j, r.i) for r in with_hex_cell(df, by=["p"]).collect()}
    assert with_hex_cell(df, by=["p"]).count() == 3
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.p, r.lat, r.j, r.i) for r in with_hex_cell(df, by=["p"]).collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_chart_has_no_window_over_raw_locations(spark):
    df = spark.createDataFrame([("a", 0.1 + 0.013 * k, 0.2 * k, 1, 1, 2, "n", "C") for k in range(50)], POINT)
    plan = with_hex_cell(df, by=["p"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_fixed_origin_and_missing_location(spark):
    df = spark.createDataFrame([("a", 0.1, 0.1, 1, 1, 2, "n", "C"), ("a", None, 1.0, 1, 1, 2, "n", "C")], POINT)
    (row,) = with_hex_cell(df, origin=(0.0, 0.0)).collect()
    assert (row.lat, row.j, row.i) == (0, 0, 0)


def test_stats_add_up_and_take_the_main_zone(spark):
    df = points(spark)
    cells = with_hex_cell(df)
    stats = hex_stats(cells).collect()
    assert sum(r.hex_attempts for r in stats) == df.count()
    by_cell = {}
    for r in cells.collect():
        by_cell.setdefault((r.lat, r.j, r.i), []).append((r.zone_range, r.name_zone))
    for r in stats:
        zones = by_cell[r.lat, r.j, r.i]
        # Most attempts first, then by name with null last.
        best = min(set(zones), key=lambda z: (-zones.count(z), z[0] is None, z[0] or "", z[1]))
        assert (r.zone_range, r.name_zone) == best and r.hex_attempts == len(zones)


def test_vertices(spark):
    stats = hex_stats(with_hex_cell(points(spark, 50)))
    corners = hex_vertices(stats)
    assert corners.count() == 6 * stats.count()
    side = 1.5 / math.sqrt(3)
    assert all(
        math.dist((r.x, r.y), (r.center_x, r.center_y)) == pytest.approx(side) for r in corners.collect()
    )
    assert corners.groupBy(*HEX).count().where("count <> 6").isEmpty()


def chart_table(spark, n=800):
    rng = random.Random(4)
    rows = [
        (rng.choice(["Ann", "Ann", "Bob"]), "2016-17", rng.choice(["1 Make", "1 Miss"]),
         float(rng.randrange(-250, 250)), float(rng.randrange(0, 400)), 5.0, rng.random() < 0.5, True,
         rng.choice(["2PT Field Goal", "3PT Field Goal"]), "Mid-Range", rng.choice(["near", "far"]),
         rng.choice(["L", None]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, schemas.STREAK_SHOTS).cache()


@pytest.mark.parametrize("scope", ["league", "self"])
def test_chart(spark, scope):
    shots = chart_table(spark)
    chart = hex_shot_chart(shots, "1 Make", "Ann", scope=scope).collect()
    cells = {(r.lat, r.j, r.i): r for r in chart}
    assert len(chart) == 6 * len(cells)
    assert sum(r.hex_attempts for r in cells.values()) == shots.where(
        "shooter = 'Ann' and streak_col = '1 Make'"
    ).count()
    most = max(r.hex_attempts for r in chart)
    for r in chart:
        assert -0.15 <= r.bounded_fg_diff <= 0.15
        assert 0.2 <= r.bounded_fg_pct <= 0.7 and 0.5 <= r.bounded_points_per_shot <= 1.5
        factor = 0.25 + 0.75 * math.log(r.hex_attempts + 1) / math.log(most + 1)
        assert r.radius_factor == pytest.approx(factor)
        assert -r.adj_x == pytest.approx(r.center_x + factor * (r.x - r.center_x))
        assert r.adj_y == pytest.approx(r.center_y + factor * (r.y - r.center_y))


@pytest.mark.parametrize("scope", ["league", "self"])
def test_charts_of_all_players_hold_those_of_each(spark, scope):
    shots = chart_table(spark)
    every = hex_shot_chart(shots, "1 Make", scope=scope)
    for player in ("Ann", "Bob"):
        one = hex_shot_chart(shots, "1 Make", player, scope=scope)
        names = sorted(one.columns)
        assert sorted(map(repr, one.select(*names).collect())) == sorted(
            map(repr, every.where(F.col("shooter") == player).select(*names).collect())
        )


def test_no_shots_give_no_rows(spark):
    assert hex_shot_chart(chart_table(spark), "3+ Makes", "Ann").collect() == []
