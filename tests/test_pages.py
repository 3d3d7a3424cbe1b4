"""Pages against the sorted table, and stored shots read by shooter."""

import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.pages import page, page_frame
from rimlight.sources import tables

SCHEMA = "team string, n long, x double"


@pytest.mark.parametrize("order", [{"n": "desc", "team": "asc"}, ["x"], {"x": "desc"}, ["team", "n"]])
def test_pages_together_are_the_table(spark, order):
    rng = random.Random(len(order))
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([0.5, 2.0, math.nan, None])) for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    place, got = None, []
    for _ in range(20):
        part, place = page(df, order, place, 7)
        got += part
        if place is None:
            break
    named = order if isinstance(order, dict) else dict.fromkeys(order, "asc")
    rest = [c for c in df.columns if c not in named]
    by = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in named.items()]
    whole = df.orderBy(*by, *[F.col(c).asc_nulls_last() for c in rest]).collect()
    assert list(map(repr, got)) == list(map(repr, whole))


def test_ends(spark):
    df = spark.createDataFrame([("a", 1, 0.5)] * 4, SCHEMA)
    rows, place = page(df, ["n"], None, 4)
    assert len(rows) == 4 and page(df, ["n"], place, 4) == ([], None)
    assert page(df.limit(0), ["n"]) == ([], None)
    assert page_frame(df, ["n"], 2, 3).count() == 1 and page_frame(df, ["n"], 3, 3).count() == 0


def test_a_page_keeps_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("string(id) team", "id n", "id * 0.5 x").write.parquet(path)
    later = spark.read.parquet(path).where(F.col("n") > 500).orderBy("n").limit(15)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=15" in plan and "GreaterThan(n,500)" in plan
    df = spark.read.parquet(path)
    rows, place = page(df, ["n"])
    assert [r.n for r in page(df, ["n"], place)[0]] == list(range(15, 30))


def test_one_shooter_reads_few_row_groups(spark, tmp_path):
    path = tmp_path / "shots"
    shots = spark.range(60_000).selectExpr(
        "concat('p', id % 400) shooter", "'2016-17' slug_season", "'1 Make' streak_col", "rand(1) * 500 location_x",
        "rand(2) * 400 location_y", "rand(3) distance_shot", "true is_shot_made", "true is_shot_attempted", "'2PT' type_shot",
        "'Mid-Range' zone_basic", "'8-16 ft.' zone_range", "'Center' name_zone",
    )
    tables.write_streak_shots(shots, str(path), row_group_bytes=40_000)
    groups = [
        pq.ParquetFile(f).metadata.row_group(i).column(0).statistics
        for f in Path(path).rglob("*.parquet")
        for i in range(pq.ParquetFile(f).metadata.num_row_groups)
    ]
    held = [s for s in groups if s.min <= "p77" <= s.max]
    assert held and len(held) < len(groups) / 10
    stored = tables.read_streak_shots(spark, str(path))
    assert stored.schema.names and set(stored.columns) == set(schemas.STREAK_SHOTS.names)

    def scanned(name):
        df = stored.where(F.col("shooter") == name)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert 150 <= scanned("p77") < 6_000
    # a name between the least and the greatest of a row group that no row has: the bloom filter knows
    assert scanned("p77x") == 0
