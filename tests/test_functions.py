import math

import pytest
from pyspark.sql import functions as F

from rimlight.functions import court, hexgrid, numeric
from rimlight.functions.names import snake_case, snake_name


def values(spark, expr, *inputs, dtype="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_fold(spark):
    assert values(spark, court.fold_half_court, 47.0, 48.0, 94.0, None) == [47, 46, 0, None]


def test_turn(spark):
    assert values(spark, lambda x: court.turn_half_court(x, F.lit(10.0)), 47.0, 48.0) == [10, 40]


def test_game_key(spark):
    assert values(spark, court.game_key, "0021500001", "00x", None, dtype="string") == [21500001, None, None]


def test_clock(spark):
    assert values(spark, lambda m: court.shot_game_clock(m, F.lit(5)), 2, dtype="int") == [125]


def test_coverage_bins(spark):
    got = values(spark, court.coverage_bin, 0.0, 1.99, 2.0, 4.0, 6.0, 300.0, None)
    assert got == ["Very Tight", "Very Tight", "Tight", "Open", "Wide Open", "Wide Open", None]


def test_coarse_coverage(spark):
    labels = ["Wide Open", "Open", "Tight", "Very Tight", "Other", None]
    assert values(spark, court.coarse_coverage, *labels, dtype="string") == [
        "Open", "Open", "Tight", "Tight", "Other", None,
    ]


def test_clamp_keeps_null(spark):
    clamp = lambda x: numeric.clamp(x, -0.15, 0.15)
    assert values(spark, clamp, -0.2, 0.0, 0.2, None) == [-0.15, 0.0, 0.15, None]


def test_zone_rank_takes_first_pattern(spark):
    texts = ["16-24 ft.", "24+ ft.", "8-16 ft.", "Back Court Shot", "Less Than 8 ft.", "other", None]
    assert values(spark, court.zone_rank, *texts, dtype="string") == [18, 24, 12, 40, 4, None, None]


def test_shot_values(spark):
    texts = ["3Pt Field Goal", "2PT Field Goal", None]
    assert values(spark, court.value_by_type, *texts, dtype="string") == [3, 2, None]
    zones = ["Backcourt", "Mid-Range", None]
    assert values(spark, court.value_by_zone, *zones, dtype="string") == [3, 2, 2]


def test_court_coordinates(spark):
    assert values(spark, court.court_x, 105.0) == [10.5]
    assert values(spark, court.court_y, 100.0) == [15.25]


def test_entity_name(spark):
    name = lambda i: court.entity_name(i, F.lit("Ann"))
    assert values(spark, name, -1, 7, dtype="long") == ["Ball", "Ann"]


def test_made_label(spark):
    assert values(spark, court.made_label, True, False, None, dtype="boolean") == ["made", "missed", None]


def test_opponent_distance(spark):
    far = lambda same: court.opponent_distance(same, F.lit(3.0))
    assert values(spark, far, True, False, None, dtype="boolean") == [300, 3, 3]


def test_effective_fg(spark):
    efg = lambda fgm: court.effective_fg(fgm, F.lit(3), F.lit(4))
    assert values(spark, efg, 2, dtype="int") == [0.875]
    none = lambda fgm: court.effective_fg(fgm, F.lit(0), F.lit(0))
    assert values(spark, none, 0, dtype="int") == [None]


def test_radius_factor(spark):
    factor = lambda n: hexgrid.radius_factor(n, F.lit(3))
    assert values(spark, factor, 3, 1, dtype="int") == [1.0, pytest.approx(0.625)]


def test_bounds(spark):
    low, high = values(spark, hexgrid.lower_bound, -3.2), values(spark, hexgrid.upper_bound, 4.0)
    assert low == [-4.5 - 1e-6] and high == [4.5 + 1e-6]


def test_rounding(spark):
    two = lambda x: numeric.round_to(x, 2)
    assert values(spark, two, 23 / 40, 1 / 3, None) == [0.58, 0.33, None]


def test_round_numeric_leaves_other_types(spark):
    df = numeric.round_numeric(spark.createDataFrame([(1.23456, 7, "a")], "x double, n int, s string"), 4)
    assert df.collect() == [(1.2346, 7, "a")]


def test_ratio(spark):
    assert values(spark, lambda x: numeric.ratio(x, F.lit(0)), 1.0) == [None]


def test_corners_are_on_a_regular_hexagon():
    corners = hexgrid.corner_offsets()
    side = 1.5 / math.sqrt(3)
    assert len(corners) == 6
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        assert math.hypot(x1, y1) == pytest.approx(side)
        assert math.hypot(x1 - x2, y1 - y2) == pytest.approx(side)


def test_names(spark):
    assert snake_name("yearSeasonLast") == "year_season_last"
    assert snake_name("urlPlayerHeadshot") == "url_player_headshot"
    assert snake_name("efg_percent_Open_1 Make") == "efg_percent_open_1_make"
    assert snake_name("3PT") == "x3pt"
    df = spark.createDataFrame([(1, 2)], ["a b", "A_B"])
    assert snake_case(df).columns == ["a_b", "a_b_2"]
