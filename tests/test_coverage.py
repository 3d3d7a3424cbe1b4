import random

import numpy as np
import pytest

from rimlight import schemas
from rimlight.operators import coverage
from rimlight.operators.percentiles import percentile_bands, percentile_breaks
from rimlight.operators.reshape import pivot_wide, union_filled
from rimlight.plans import coverage_bands, coverage_table


def row(game, event, shooter, made, bin_, type_="2PT Field Goal", streak="1 Make", team="T"):
    return (game, event, streak, shooter, team, 1.0, None, type_, None, None, None, 1.0, True, made, "X", 1.0, bin_)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.ENRICHED)


def test_hand_case(spark):
    rows = [
        row(1, 1, "Ann", True, "Wide Open", "3PT Field Goal", team="Old"),
        row(1, 2, "Ann", True, "Open", "3PT Field Goal", team="Old"),
        row(2, 1, "Ann", False, "Open", "3PT Field Goal", team="New"),
        row(1, 9, "Ann", False, "Open", team="Old"),
        row(3, 1, "Ann", True, "Very Tight", streak="2 Makes", team="Newest"),
        row(3, 2, "Bob", True, "Tight", streak="2 Makes"),
    ]
    (got,) = coverage_table(frame(spark, rows), "1 Make").collect()
    assert got.asDict() == {
        "shooter_team_name": "New",
        "shooter": "Ann",
        "total_fga": 5,
        "streak_fga": 4,
        "percent_fga_tight": 0.2,
        "base_streak_efg": 0.875,
        "efg_open": 0.875,
        "efg_tight": 0.0,
        "coverage_diff": -0.875,
    }
    (made,) = coverage_table(frame(spark, rows), "1 Make", made_threes=True).collect()
    assert made.base_streak_efg == 0.75
    (unfilled,) = coverage_table(frame(spark, rows), "1 Make", fill=None).collect()
    assert unfilled.efg_tight is None and unfilled.coverage_diff is None


def random_rows(n=600):
    rng = random.Random(9)
    return [
        row(rng.randrange(20), e, rng.choice(["Ann", "Bob", "Cat"]), rng.random() < 0.5,
            rng.choice(["Wide Open", "Open", "Tight", "Very Tight", None]),
            rng.choice(["2PT Field Goal", "3PT Field Goal"]), rng.choice(["1 Make", "1 Miss", "0"]),
            f"T{rng.randrange(3)}")
        for e in range(n)
    ]


def test_one_pass_table_equals_the_separate_tables(spark):
    rows = frame(spark, random_rows()).cache()
    table = {r.shooter: r for r in coverage_table(rows, "1 Make").collect()}
    totals = {r.shooter: r for r in coverage.coverage_totals(rows).collect()}
    base = {r.shooter: r for r in coverage.streak_efg(rows, "1 Make").collect()}
    wide = {r.shooter: r for r in coverage.coverage_pivot(rows, "1 Make").collect()}
    teams = {r.shooter: r for r in coverage.shooter_teams(rows, "1 Make").collect()}
    assert table.keys() == base.keys()
    for shooter, r in table.items():
        assert r.total_fga == totals[shooter].total_fga
        assert r.percent_fga_tight == round(totals[shooter].percent_fga_tight, 4)
        assert r.base_streak_efg == round(base[shooter].base_streak_efg, 4)
        assert r.efg_open == round(wide[shooter].efg_percent_open, 4)
        assert r.efg_tight == round(wide[shooter].efg_percent_tight, 4)
        assert r.streak_fga == wide[shooter].fga_open + wide[shooter].fga_tight
        assert r.shooter_team_name == teams[shooter].shooter_team_name


def test_sorted_by_streak_attempts(spark):
    got = [r.streak_fga for r in coverage_table(frame(spark, random_rows()), "1 Make").collect()]
    assert got == sorted(got, reverse=True)


def test_bands_of_the_table(spark):
    bands = coverage_bands(frame(spark, random_rows()), "1 Make").collect()
    ranked = sorted(bands, key=lambda r: r.base_streak_efg)
    assert [r.band for r in ranked] == sorted(r.band for r in bands)
    assert ranked[0].band == 0 and ranked[-1].band == 100


@pytest.mark.parametrize("max_values", [1_000_000, 40, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_are_exact(spark, max_values, seed):
    rng = random.Random(seed)
    # Half of the column is one value.
    data = [7.5 if rng.random() < 0.5 else round(rng.lognormvariate(1, 2), rng.choice([1, 5])) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in [*data, None, float("nan")]], "v double")
    breaks = {r.percent: r.breakpoint for r in percentile_breaks(df, "v", max_bucket_values=max_values).collect()}
    expected = np.percentile(data, range(101))
    assert len(breaks) == 101
    assert [breaks[k] for k in range(101)] == pytest.approx(list(expected), rel=1e-12)


@pytest.mark.parametrize("data", [[3.0], [1.0, 2.0], [5.0] * 10, []])
def test_percentiles_of_little(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got = sorted(tuple(r) for r in percentile_breaks(df, "v").collect())
    expected = list(np.percentile(data, range(101))) if data else []
    assert [b for _, b in got] == pytest.approx(expected)


def test_bands_count_the_breaks_below(spark):
    rng = random.Random(3)
    data = [round(rng.gauss(0, 1), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*data, None]], "v double")
    breaks = [r.breakpoint for r in percentile_breaks(df, "v").collect()]
    for r in percentile_bands(df, "v").collect():
        assert r.band == (None if r.v is None else sum(b < r.v for b in breaks))


def test_pivot_with_one_measure(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "Open", 1), ("b", "Other", 2)], "k string, c string, n int")
    wide = pivot_wide(df, ["k"], "c", ["Open", "Tight"], {"n": F.sum("n")})
    assert sorted(tuple(r) for r in wide.collect()) == [("a", 1, 0), ("b", 0, 0)]
    assert wide.columns == ["k", "n_open", "n_tight"]


def test_union_fills(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2, 0.5)], "n int, d double")
    assert sorted(map(tuple, union_filled(a, b).collect())) == [(1, "x", None), (2, None, 0.5)]
