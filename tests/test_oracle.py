"""Each registered query against its SQL."""

import os

import pytest
from parity import compare, connect

import __spark_entry__ as entry
from rimlight.oracle import ORACLE_SQL
from rimlight.queries import QUERIES

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
# Too few suppliers at the smallest scale for any game to pass the gate.
EMPTY_AT_SMALLEST = {"quality_gate", "ingest_games", "ingest_two_batches", "ingest_documents", "ingest_carried_labels"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    problems = compare(QUERIES[name](spark, SF_DIR), duck, ORACLE_SQL[name])
    if name in EMPTY_AT_SMALLEST and SF_DIR.endswith("sf0.001"):
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


def test_contract(spark):
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == [
        "shooter", "zone_range", "name_zone", "zone_pct", "zone_points_per_shot", "league_pps",
    ]
