"""Documents cut at their events against the same documents read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_logs import GOOD, MALFORMED, moment, write

from rimlight.operators.flatten import flatten_marked, flatten_tracking
from rimlight.sources import game_logs
from rimlight.sources.split_logs import LATE_ID, split_logs


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that a small file has many, with cuts anywhere in an event."""
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def both(spark, path, rule, **options):
    """(rows, problems) of the files read whole and cut."""
    whole = game_logs.read_game_logs(spark, str(path), **options)
    cut = split_logs(spark, str(path), rule, **options)
    rows = [flatten_tracking(game_logs.usable_logs(whole, rule)), flatten_tracking(cut.where("problem is null"))]
    if rule == "skip_event":
        # dropped events leave gaps
        rows = [r.drop("event_pos") for r in rows]
    problems = [game_logs.quarantined_logs(whole, rule), cut.where("problem is not null").select("game_id", "source_file", "problem")]
    return [sorted(map(str, r.collect())) for r in rows], [sorted(map(str, p.collect())) for p in problems]


def game(rng, events, **more):
    made = []
    for k in range(events):
        moments = [moment((2, 700.0 - k), (3, rng.choice([None, 5.5]))) for _ in range(rng.randrange(4))]
        made.append({"eventId": str(k), "visitor": {"name": 'a "eventId" }, { b' if k % 3 else "é€"}, "moments": moments})
    return {"gameid": "x", "events": made, **more}


@pytest.mark.parametrize("rule", ["skip_document", "skip_event", "skip_game"])
def test_equal_to_whole_documents(small_splits, tmp_path, rule):
    rng = random.Random(1)
    write(tmp_path, "0021500001.json", game(rng, 60))
    write(tmp_path, "0021500002.JSON", json.dumps(game(rng, 25, gamedate="d", after={"z": [1, {}]}), indent=3) + "\n\n")
    write(tmp_path, "0021500003.json", json.dumps(game(rng, 1), ensure_ascii=False))
    write(tmp_path, "0021500004.json", {"events": []})
    write(tmp_path, "0021500005.json", {"other": 1})
    write(tmp_path, "0021500006.json", {"events": None})
    write(tmp_path, "0021500007.json", "{broken")
    for k, event in enumerate(MALFORMED.values()):
        middle = game(rng, 12)
        middle["events"].insert(k, event)
        write(tmp_path, f"00215001{k}.json", middle)
    for k in (1, 2, 3, 9, 20, 60, 90, 150, 300):
        write(tmp_path, f"002150020{k}.json", json.dumps(game(rng, 8))[:-k])
    rows, problems = both(small_splits, tmp_path, rule)
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert problems[0] == problems[1] and len(problems[0]) >= 10


def test_files_of_one_game(small_splits, tmp_path):
    rng = random.Random(2)
    for name, bad in (("1", False), ("2", True)):
        folder = tmp_path / f"game=00{name}"
        folder.mkdir()
        for k in range(2):
            document = game(rng, 10)
            if bad and k:
                document["events"].append(MALFORMED["short_moment"])
            write(folder, f"part{k}.json", document)
    write(tmp_path, "stray.json", GOOD)
    for rule in ("skip_document", "skip_event", "skip_game"):
        rows, problems = both(small_splits, tmp_path, rule, id_folder="game")
        assert rows[0] == rows[1] and rows[0] and problems[0] == problems[1]


def test_a_large_document_is_shared_by_tasks(small_splits, tmp_path):
    write(tmp_path, "0021500001.json", game(random.Random(3), 400))
    cut = split_logs(small_splits, str(tmp_path))
    assert [r.first_event for r in cut.where("size(events) > 0").orderBy("first_event").collect()] == list(range(400))
    scan = small_splits.read.option("lineSep", '"eventId"').text(str(tmp_path))
    sizes = [r["count"] for r in scan.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 40
    # no row holds more than one event
    assert cut.agg(F.max(F.size("events"))).first()[0] == 1


def test_ids_after_the_moments_are_set_aside(small_splits, tmp_path):
    late = [{"moments": [moment()], "eventId": str(k)} for k in range(3)]
    write(tmp_path, "0021500001.json", {"events": late})
    first = [{"visitor": 1, "eventId": str(k), "moments": [moment()]} for k in range(3)]
    write(tmp_path, "0021500002.json", {"events": first})
    marked = flatten_marked(split_logs(small_splits, str(tmp_path)))
    assert [(r.game_id, r.problem) for r in marked.where("problem is not null").collect()] == [("0021500001", LATE_ID)]
    assert sorted((r.game_id, r.event_pos) for r in marked.where("problem is null").collect()) == [("0021500002", k) for k in range(3)]


def test_no_files(spark, tmp_path):
    assert split_logs(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="unknown rule"):
        split_logs(spark, str(tmp_path), "other")
