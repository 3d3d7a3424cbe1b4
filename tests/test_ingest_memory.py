"""What an ingest keeps on the driver: files of one batch, no statuses of files that were read."""

import json

import pytest

from rimlight import schemas
from rimlight.session import listing_session
from rimlight.sources.tracking import read_batches
from rimlight.streaming import ingest
from rimlight.streaming.ingest import IngestPaths, ingest_games, ingested_shots

EVENTS, GAMES = range(1, 13), [f"00215000{n:02d}" for n in range(1, 6)]
STATUSES = "spark.sql.hive.filesourcePartitionFileCacheSize"


def log():
    def moment(n):
        return [1, 0, 110.0 - n, None, None, [[-1, -1, 20.0 + n, 10.0, 3.0], [10, 1, 20.0 + n, 10.0, 0.0], [20, 2, 9.0, 9.0 + n, 0.0]]]

    return json.dumps({"events": [{"eventId": str(e), "moments": [moment(n) for n in range(4)]} for e in EVENTS]})


@pytest.fixture
def setup(spark, tmp_path):
    for game in GAMES:
        (tmp_path / "logs" / f"game={game}").mkdir(parents=True)
        (tmp_path / "logs" / f"game={game}" / "part-0.json").write_text(log())
    rows = [
        (game[2:], e, "Ann", "T", 1, 40, "e", "a", "2PT Field Goal", "Mid-Range", "C", "8-16 ft.", 9.0, True, True, None)
        for game in GAMES
        for e in EVENTS
    ]
    paths = IngestPaths(*[str(tmp_path / p) for p in ("logs", "tracking", "enriched", "checkpoint")])
    players = spark.createDataFrame([(1, "Ann", 2016, ""), (2, "Bob", 2016, "")], schemas.PLAYERS)
    return paths, spark.createDataFrame(rows, schemas.SHOTS), players


def test_batches_are_bounded_though_no_bound_is_named(spark, setup, monkeypatch, tmp_path):
    paths, shots, players = setup
    monkeypatch.setattr(ingest, "MAX_FILES", 2, raising=False)
    options = {"id_folder": "game", "clean_source": "archive", "archive_dir": str(tmp_path / "archive")}
    ingest_games(spark, paths, shots, players, **options).awaitTermination()
    batches = [r[0] for r in read_batches(spark, paths.enriched).select("batch").distinct().collect()]
    assert sorted(batches) == [0, 1, 2]
    found = ingested_shots(spark, paths).collect()
    assert sorted((r.game_id, r.event_id) for r in found) == [(int(g), e) for g in GAMES for e in EVENTS]
    # files of earlier batches went to the archive while later ones ran, so that a later run lists fewer
    left = len(list((tmp_path / "logs").rglob("*.json")))
    assert left < len(GAMES) and left + len(list((tmp_path / "archive").rglob("*.json"))) == len(GAMES)


def test_a_named_bound_holds(spark, setup, monkeypatch):
    paths, shots, players = setup
    monkeypatch.setattr(ingest, "MAX_FILES", 1, raising=False)
    ingest_games(spark, paths, shots, players, id_folder="game", max_files=4).awaitTermination()
    assert read_batches(spark, paths.enriched).select("batch").distinct().count() == 2


def test_streams_cache_no_file_statuses(spark):
    before = spark.conf.get(STATUSES)
    session = listing_session(spark)
    cache = spark._jvm.org.apache.spark.sql.execution.datasources.FileStatusCache
    assert "NoopCache" in cache.getOrCreate(session._jsparkSession).toString()
    assert "NoopCache" not in cache.getOrCreate(spark._jsparkSession).toString()
    assert spark.conf.get(STATUSES) == before != "0"
