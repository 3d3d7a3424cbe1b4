"""Queries against SQL on tables in which one key or value holds a third of the rows."""

from functools import partial
from pathlib import Path

import pytest
from parity import TABLES, compare, connect
from pyspark.sql import functions as F

from rimlight import adapters
from rimlight.operators import tracking
from rimlight.operators.streaks import label_streaks
from rimlight.oracle import ORACLE_SQL
from rimlight.queries import QUERIES

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = connect(SOURCE)
    con.execute(
        f"""COPY (SELECT * REPLACE (
          CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
          CASE WHEN event_id % 3 = 1 THEN 42.5 ELSE value END AS value) FROM events)
        TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(
        f"""COPY (SELECT * EXCLUDE (r) REPLACE (
          CASE WHEN r % 3 = 0 THEN 193 ELSE l_orderkey END AS l_orderkey,
          CASE WHEN r % 3 = 0 THEN 1000000 + r ELSE l_partkey END AS l_partkey)
          FROM (SELECT *, row_number() OVER () AS r FROM lineitem))
        TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
    )
    for name in TABLES:
        if not (folder / f"{name}.parquet").exists():
            (folder / f"{name}.parquet").symlink_to(Path(SOURCE) / f"{name}.parquet")
    return str(folder)


@pytest.fixture
def hot_settings(spark, monkeypatch):
    """Small chunks, no broadcasts, and skewed partitions split from a few KB on."""
    monkeypatch.setattr(adapters, "label_streaks", partial(label_streaks, max_group_rows=200))
    monkeypatch.setattr(tracking, "fits_broadcast", lambda df, *limit: False)
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    [
        "streak_labels",
        "zone_tables_league",
        "zone_tables_self",
        "hex_cells",
        "hex_chart",
        "coverage_table",
        "percentile_bands",
        "enriched_shots",
        "quality_gate",
    ],
)
def test_equals_sql(spark, skewed, hot_settings, name):
    assert compare(QUERIES[name](spark, skewed), connect(skewed), ORACLE_SQL[name]) == []


def test_hot_shooter_is_cut(spark, skewed, hot_settings):
    shots = adapters.event_shots(spark, skewed)
    labelled = adapters.label_streaks(shots, order=("ts", "event_id"), reset=())
    text = labelled._jdf.queryExecution().toString()
    assert "_chunk" in text
    hot = shots.where(F.col("shooter") == "7").count()
    assert hot > shots.count() / 3
