import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rimlight.operators import streaks
from rimlight.operators.streaks import label_streaks, streak_or_zero

SCHEMA = "shooter string, game_id int, ts timestamp, event_id long, is_shot_made boolean"


def brute(rows, reset, cap=3):
    """event_id -> label by walking each group in order."""
    labels, runs = {}, {}
    for shooter, game, _ts, event, made in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (shooter, game) if reset else shooter
        last, run = runs.get(key, (None, 0))
        if not run:
            labels[event] = None
        else:
            size = f"{cap}+" if run >= cap else str(run)
            one, many = ("Make", "Makes") if last else ("Miss", "Misses")
            labels[event] = f"{size} {one if size == '1' else many}"
        runs[key] = (made, run + 1 if made == last else 1)
    return labels


def shots(seed, n=600, hot=0.4):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for event in range(n):
        shooter = "hot" if rng.random() < hot else f"p{rng.randrange(12)}"
        # Bursts and ties in time.
        ts = start + timedelta(minutes=rng.choice([rng.randrange(40), rng.randrange(20000)]))
        rows.append((shooter, rng.randrange(4), ts, event, rng.random() < 0.5))
    return rows


def labels(df):
    return {r["event_id"]: r["streak_col"] for r in df.collect()}


def test_hand_case(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", 1, start, i, made) for i, made in enumerate([True] * 4 + [False] * 2)]
    got = labels(label_streaks(spark.createDataFrame(rows, SCHEMA), order=("event_id",)))
    assert [got[i] for i in range(6)] == [None, "1 Make", "2 Makes", "3+ Makes", "3+ Makes", "1 Miss"]


@pytest.mark.parametrize("reset", [(), ("game_id",)])
@pytest.mark.parametrize("max_rows", [1_000_000, 50, 7, 1])
def test_chunks_give_the_labels_of_whole_groups(spark, reset, max_rows):
    rows = shots(11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = label_streaks(df, order=("ts", "event_id"), reset=reset, max_group_rows=max_rows)
    assert got.columns == [*df.columns, "streak_col"]
    assert labels(got) == brute(rows, reset)


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_other_caps(spark, cap):
    rows = shots(5, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    for max_rows in (1_000_000, 10):
        got = label_streaks(df, order=("ts", "event_id"), reset=(), cap=cap, max_group_rows=max_rows)
        assert labels(got) == brute(rows, (), cap)


def test_label_ignores_later_shots(spark):
    rows = shots(3, 200)
    cut = sorted(rows, key=lambda r: (r[2], r[3]))[:120]
    whole = labels(label_streaks(spark.createDataFrame(rows, SCHEMA), order=("ts", "event_id"), reset=()))
    part = labels(label_streaks(spark.createDataFrame(cut, SCHEMA), order=("ts", "event_id"), reset=()))
    assert part == {k: whole[k] for k in part}


def test_unknown_results_keep_their_rows_and_make_no_run(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", 1, start, 0, True), ("a", 1, start, 1, None), ("a", 1, start, 2, True)]
    got = labels(label_streaks(spark.createDataFrame(rows, SCHEMA), order=("event_id",)))
    assert got == {0: None, 1: None, 2: "1 Make"}


def test_rows_without_time_sort_first_in_chunks_too(spark):
    rows = [("a", 1, None if i < 4 else datetime(2024, 1, i), i, i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = label_streaks(df, order=("ts", "event_id"))
    cut = label_streaks(df, order=("ts", "event_id"), max_group_rows=3)
    assert labels(whole) == labels(cut)


def test_text_orders_are_cut_as_well(spark):
    df = spark.createDataFrame(shots(1, 60), SCHEMA).withColumn("place", F.date_format("ts", "yyyyMMddHHmmss"))
    order = ("place", "event_id")
    whole = label_streaks(df, order=order)
    cut = label_streaks(df, order=order, max_group_rows=4)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_stored_form(spark):
    df = spark.createDataFrame([(None,), ("1 Make",)], "streak_col string")
    assert [r[0] for r in df.select(streak_or_zero()).collect()] == ["0", "1 Make"]
    assert df.where(F.col("streak_col").isNull()).count() == 1


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "date", "int", "double"])
def test_ties_in_the_leading_column(spark, dtype):
    """All rows of the hot shooter in few order values: ties are cut by the event."""
    rows = shots(8, 400)
    lead = {
        "timestamp": F.date_trunc("week", "ts"),
        "timestamp_ntz": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
        "date": F.to_date("ts"),
        "int": F.dayofmonth("ts"),
        "double": F.hour("ts") / 7,
    }[dtype]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lead", lead)
    whole = label_streaks(df, order=("lead", "event_id"), reset=())
    assert df.schema["lead"].dataType.simpleString() == dtype
    for max_rows in (40, 5):
        cut = label_streaks(df, order=("lead", "event_id"), reset=(), max_group_rows=max_rows)
        assert labels(cut) == labels(whole)


def test_equal_lead_is_cut_by_the_second_column(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, start, i, i % 3 == 0) for i in range(100)], SCHEMA)
    groups, chunk = streaks._oversized(df, ["shooter"], ["ts", "event_id"], 10)
    sizes = df.join(groups, "shooter").groupBy(chunk.alias("c")).count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 10


def test_microseconds_are_kept_apart(spark):
    rows = [("a", 1, datetime(2024, 3, 31, 2, 30, 0, i), 99 - i, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    whole = label_streaks(df, order=("ts", "event_id"))
    cut = label_streaks(df, order=("ts", "event_id"), max_group_rows=4)
    assert labels(cut) == labels(whole)


def test_cuts_hold_for_any_ids_and_stray_clocks(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    rows = [("a", 1, start, i, rng.random() < 0.5) for i in ids]
    rows += [("b", 1, start + timedelta(seconds=k) if k else datetime(1970, 1, 1), k, k % 3 > 0) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = label_streaks(df, order=("ts", "event_id"))
    cut = label_streaks(df, order=("ts", "event_id"), max_group_rows=20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    keys = ["shooter", "game_id"]
    groups, chunk = streaks._oversized(df, keys, ("ts", "event_id"), 200)
    sizes = df.join(groups, keys).groupBy(chunk.alias("c")).count().collect()
    assert max(r["count"] for r in sizes) <= 400
