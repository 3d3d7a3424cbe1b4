import json

import pytest
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.flatten import flatten_marked, flatten_tracking
from rimlight.sources import game_logs, tracking

BALL = [-1, -1, 40.1, 25.0, 3.2]
GOOD = {
    "events": [
        {
            "eventId": "2",
            "moments": [
                [1, 1446000000000, 719.5, 23.1, None, [BALL, [161, 2000, 60.0, 20.0, 0.0]]],
                [1, 1446000000040, 719.46, None, None, [[-1, -1, 40.2, 25.0, 3.2]]],
            ],
        },
        {"eventId": "3", "moments": []},
    ]
}


def moment(*changes, size=6):
    m = [1, 0, 700.0, 20.0, None, [BALL]]
    for at, value in changes:
        m[at] = value
    return m[:size]


MALFORMED = {
    "no_moments": {"eventId": "4"},
    "no_id": {"moments": []},
    "short_moment": {"eventId": "4", "moments": [moment(size=5)]},
    "no_entities": {"eventId": "4", "moments": [moment((5, None))]},
    "short_entity": {"eventId": "4", "moments": [moment((5, [BALL, [1, 2, 3.0]]))]},
    "long_entity": {"eventId": "4", "moments": [moment((5, [[*BALL, 1.0]]))]},
}


def types(df):
    """Names and types, whatever the nullability."""
    return [(f.name, f.dataType) for f in df.schema.fields]


def names_and_types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def write(folder, name, document):
    text = document if isinstance(document, str) else json.dumps(document)
    (folder / name).write_text(text)


def test_flatten(spark, tmp_path):
    write(tmp_path, "0021500001.json", GOOD)
    docs = game_logs.read_game_logs(spark, str(tmp_path))
    rows = flatten_tracking(game_logs.usable_logs(docs))
    assert types(rows) == names_and_types(schemas.TRACKING)
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[-3:]) == [
        (-1, -1, 40.1, 25.0, 3.2, 719.5, 23.1, 1, "0021500001", 2, 0, 0, 0),
        (161, 2000, 60.0, 20.0, 0.0, 719.5, 23.1, 1, "0021500001", 2, 0, 0, 1),
        (-1, -1, 40.2, 25.0, 3.2, 719.46, None, 1, "0021500001", 2, 0, 1, 0),
    ]


def test_pretty_printed_and_upper_case_file(spark, tmp_path):
    write(tmp_path, "0021500009.JSON", json.dumps(GOOD, indent=2))
    write(tmp_path, "notes.txt", "not a log")
    rows = flatten_tracking(game_logs.usable_logs(game_logs.read_game_logs(spark, str(tmp_path))))
    assert {r.game_id for r in rows.collect()} == {"0021500009"}


@pytest.mark.parametrize("kind", list(MALFORMED))
def test_malformed_event(spark, tmp_path, kind):
    write(tmp_path, "0021500001.json", GOOD)
    write(tmp_path, "0021500002.json", {"events": [*GOOD["events"], MALFORMED[kind]]})
    docs = game_logs.read_game_logs(spark, str(tmp_path))
    games = lambda rule: {
        (r.game_id, r["count"])
        for r in flatten_tracking(game_logs.usable_logs(docs, rule)).groupBy("game_id").count().collect()
    }
    assert games("skip_game") == {("0021500001", 3)}
    assert games("skip_event") == {("0021500001", 3), ("0021500002", 3)}
    assert [(r.game_id, r.problem) for r in game_logs.quarantined_logs(docs).collect()] == [
        ("0021500002", "malformed event")
    ]


def test_corrupt_documents_are_set_aside(spark, tmp_path):
    write(tmp_path, "0021500001.json", GOOD)
    write(tmp_path, "0021500002.json", json.dumps(GOOD)[:-20])
    write(tmp_path, "0021500003.json", {"other": 1})
    docs = game_logs.read_game_logs(spark, str(tmp_path))
    assert flatten_tracking(game_logs.usable_logs(docs)).count() == 3
    problems = {r.game_id: r.problem for r in game_logs.quarantined_logs(docs).collect()}
    assert problems == {"0021500002": "corrupt document", "0021500003": "no events"}
    marked = flatten_marked(game_logs.marked_logs(docs))
    assert types(marked) == names_and_types(schemas.MARKED_TRACKING)
    assert marked.where(F.col("problem").isNull()).count() == 3
    assert {r.game_id: r.problem for r in marked.where(F.col("problem").isNotNull()).collect()} == problems


def test_lines_layout(spark, tmp_path):
    lines = [json.dumps({"gameid": f"002150000{n}", **GOOD}) for n in (1, 2)] + ["{broken"]
    write(tmp_path, "all.json", "\n".join(lines))
    docs = game_logs.read_game_logs(spark, str(tmp_path), layout="lines")
    rows = flatten_tracking(game_logs.usable_logs(docs))
    assert {(r.game_id, r["count"]) for r in rows.groupBy("game_id").count().collect()} == {
        ("0021500001", 3), ("0021500002", 3),
    }
    assert game_logs.quarantined_logs(docs).count() == 1


def test_malformed_line_drops_its_whole_game(spark, tmp_path):
    bad = {"events": [*GOOD["events"], next(iter(MALFORMED.values()))]}
    write(tmp_path, "a.json", "\n".join(json.dumps({"gameid": f"002150000{n}", **GOOD}) for n in (1, 2)))
    write(tmp_path, "b.json", json.dumps({"gameid": "0021500002", **bad}) + "\n{broken")
    docs = game_logs.read_game_logs(spark, str(tmp_path), layout="lines")
    rows = flatten_tracking(game_logs.usable_logs(docs, "skip_game"))
    assert {(r.game_id, r["count"]) for r in rows.groupBy("game_id").count().collect()} == {("0021500001", 3)}
    documents = flatten_tracking(game_logs.usable_logs(docs))
    assert {r.game_id for r in documents.collect()} == {"0021500001", "0021500002"}
    events = flatten_tracking(game_logs.usable_logs(docs, "skip_event"))
    assert {r.game_id for r in events.collect()} == {"0021500001", "0021500002"}
    # the documents with a problem of their own
    assert game_logs.quarantined_logs(docs).count() == 2


def test_unknown_names(spark, tmp_path):
    write(tmp_path, "1.json", GOOD)
    with pytest.raises(ValueError):
        game_logs.read_game_logs(spark, str(tmp_path), layout="zip")
    with pytest.raises(ValueError):
        game_logs.usable_logs(game_logs.read_game_logs(spark, str(tmp_path)), "ignore")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("per_game", [True, False])
def test_tracking_round_trip(spark, tmp_path, fmt, per_game):
    write(tmp_path, "0021500001.json", GOOD)
    write(tmp_path, "0021500002.json", GOOD)
    rows = flatten_tracking(game_logs.usable_logs(game_logs.read_game_logs(spark, str(tmp_path))))
    out = str(tmp_path / "out")
    tracking.write_tracking(rows, out, fmt=fmt, per_game=per_game)
    read = tracking.read_tracking if fmt == "parquet" else tracking.read_tracking_csv
    got = read(spark, out)
    assert types(got.select(*rows.columns)) == types(rows)
    assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def enriched(spark, games):
    rows = [(g, e, "0", "Ann", "T", 1.0, *[None] * 5, 1.0, True, True, "Bob", d, "Open") for g, e, d in games]
    return spark.createDataFrame(rows, schemas.ENRICHED)


def test_replaced_games_and_appended_rows(spark, tmp_path):
    path = str(tmp_path / "shots")
    tracking.write_enriched(enriched(spark, [(1, 1, 4.0), (2, 1, 4.0)]), path)
    tracking.write_enriched(enriched(spark, [(2, 1, 5.0), (2, 2, 5.0)]), path)
    got = lambda: sorted(
        (r.game_id, r.event_id, r.distance_to_shooter) for r in tracking.read_enriched(spark, path).collect()
    )
    assert got() == [(1, 1, 4.0), (2, 1, 5.0), (2, 2, 5.0)]
    tracking.write_enriched(enriched(spark, [(1, 1, 4.0)]), path, mode="append")
    assert got() == [(1, 1, 4.0), (1, 1, 4.0), (2, 1, 5.0), (2, 2, 5.0)]
    with pytest.raises(ValueError):
        tracking.write_enriched(enriched(spark, []), path, mode="merge")


def test_stored_tables(spark, tmp_path):
    from rimlight.sources import tables

    path = str(tmp_path / "players")
    rows = [(1, "Ann", 2015, "u1"), (2, "Bob", 2014, "u2"), (3, "Cat", 2020, "u3")]
    spark.createDataFrame(rows, schemas.PLAYERS).write.parquet(path)
    assert tables.read_players(spark, path).columns == ["idPlayer", "namePlayer"]
    players = tables.read_table(spark, path, schemas.PLAYERS)
    assert {tuple(r) for r in tables.active_players(players).collect()} == {("u1", "Ann"), ("u3", "Cat")}
    assert [tuple(r) for r in tables.active_players(players, name="Cat").collect()] == [("u3", "Cat")]
