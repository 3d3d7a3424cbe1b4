"""Games in several batches: rows of events that came once are not moved to find the latest."""

from rimlight import adapters, queries, schemas
from rimlight.sources.tracking import BATCH, latest_events, write_batch
from rimlight.streaming.ingest import IngestPaths, earlier_tracking


def tracked(spark, games):
    row = dict.fromkeys(schemas.MARKED_TRACKING.names)
    rows = [tuple({**row, "game_id": g, "event_id": 1}.values()) for g in games]
    return spark.createDataFrame(rows, schemas.MARKED_TRACKING)


def test_events_sent_once_are_not_shuffled(spark):
    once = spark.createDataFrame([("g", 1, 0, 5), ("g", 2, 1, 6), ("g", None, 1, 7)], "game_id string, event_id long, batch long, x int")
    found = latest_events(once)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(r.x for r in found.collect()) == [5, 6]


def test_an_event_sent_again_has_its_latest_rows(spark):
    rows = [("g", 1, 0, 1), ("g", 1, 2, 2), ("g", 1, 2, 3), ("g", 2, 0, 4), ("h", 1, 0, 5), ("h", 1, 1, 6), (None, 1, 0, 7)]
    found = latest_events(spark.createDataFrame(rows, "game_id string, event_id long, batch long, x int"))
    assert found.columns == ["game_id", "event_id", "x"]
    assert sorted(r.x for r in found.collect()) == [2, 3, 4, 6]


def test_earlier_rows_are_those_of_the_known_games(spark, tmp_path):
    paths = IngestPaths(*[str(tmp_path / p) for p in ("logs", "tracking", "enriched", "checkpoint")])
    sent = [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("d", 1), ("d", 2)]
    for batch in (0, 1, 2):
        games = [g for g, b in sent if b == batch]
        write_batch(tracked(spark, games), paths.tracking, batch)
    every = spark.createDataFrame(sent, f"game_id string, {BATCH} long")
    for known in ([("a", 0)], [("a", 0), ("b", 0)], [("a", 0), ("b", 0), ("c", 0)], [("b", 0), ("a", 1), ("d", 1)], [("d", 2)]):
        found = earlier_tracking(spark, paths, spark.createDataFrame(known, every.schema), every)
        assert found.columns == [*schemas.TRACKING.names, BATCH]
        assert sorted((r.game_id, r.batch) for r in found.collect()) == sorted(known)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (len(known) < sum(b in {x for _, x in known} for _, b in sent))


def test_lines_of_both_halves_are_made_once(spark, tmp_path):
    rows = [(k, k + 1, "F", 1e5, p) for k, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"] * 5)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    halves = queries._halves(spark, str(tmp_path), queries.F.col("value"))
    for half in halves:
        assert "to_json" not in half._jdf.queryExecution().optimizedPlan().toString()
    lines = sorted(r.value for r in adapters.game_log_lines(spark, str(tmp_path)).collect())
    assert sorted(r.value for half in halves for r in half.collect()) == lines
    assert all(half.count() for half in halves)
