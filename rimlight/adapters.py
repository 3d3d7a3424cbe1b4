"""Domain tables derived from the general test tables (events, lineitem, orders, supplier).

The test tables hold no basketball data. Each adapter is a row-by-row projection of one whole table,
so the work of a query grows with its table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.operators.streaks import label_streaks, streak_or_zero
from rimlight.session import cut_lineage, scratch_path
from rimlight.sources.game_logs import read_game_logs

# Orders per game, and number of shooters; ids below the latter exist as suppliers at most scales.
GAME_SHOTS = 40
SHOOTERS = 97
FIRST_GAME = 20000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STREAK_SHOTS columns without the label, plus ts and event_id, over events."""
    value, event_id = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("shooter"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("slug_season"),
        "ts",
        "event_id",
        (event_id * 37 % 500 - 250).cast("double").alias("location_x"),
        (event_id * 91 % 420).cast("double").alias("location_y"),
        value.alias("distance_shot"),
        F.col("event_type").isin("click", "purchase").alias("is_shot_made"),
        F.lit(True).alias("is_shot_attempted"),
        F.when(value > 50, "3PT Field Goal").otherwise("2PT Field Goal").alias("type_shot"),
        F.when(value < 20, "Restricted Area")
        .when(value < 50, "Mid-Range")
        .when(value < 60, "Left Corner 3")
        .when(value < 150, "Above the Break 3")
        .otherwise("Backcourt")
        .alias("zone_basic"),
        F.when(value < 20, "Less Than 8 ft.")
        .when(value < 40, "8-16 ft.")
        .when(value < 60, "16-24 ft.")
        .when(value < 150, "24+ ft.")
        .otherwise("Back Court Shot")
        .alias("zone_range"),
        F.when(event_id % 3 == 0, "Center")
        .when(event_id % 3 == 1, "Left Side")
        .otherwise("Right Side")
        .alias("name_zone"),
    )


def streak_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_shots`` with the streak label over all of a user's events."""
    return label_streaks(event_shots(spark, sf_dir), order=("ts", "event_id"), reset=())


def stored_streak_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``streak_shots`` written to the shared folder, as the labelled season table is stored."""
    return cut_lineage(streak_shots(spark, sf_dir))


def covered_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENRICHED columns over events: a game is a day, the coverage follows from the event id."""
    event_id = F.col("event_id")
    return streak_shots(spark, sf_dir).select(
        F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("game_id"),
        "event_id",
        streak_or_zero().alias("streak_col"),
        "shooter",
        F.concat(F.lit("Team "), (event_id % 7).cast("string")).alias("shooter_team_name"),
        "type_shot",
        "zone_basic",
        "name_zone",
        "zone_range",
        "distance_shot",
        "is_shot_attempted",
        "is_shot_made",
        F.when(event_id % 4 == 0, "Wide Open")
        .when(event_id % 4 == 1, "Open")
        .when(event_id % 4 == 2, "Tight")
        .otherwise("Very Tight")
        .alias("closest_defender_distance_bin"),
    )


def _game(order_key: Column) -> Column:
    return (F.lit(FIRST_GAME) + F.floor(order_key / GAME_SHOTS)).cast("string")


def order_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOTS over orders: one shot per order, GAME_SHOTS orders per game."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    shooter = (key % SHOOTERS).cast("string")
    return table(spark, sf_dir, "orders").select(
        _game(key).alias("game_id"),
        key.alias("event_id"),
        F.concat(F.lit("Supplier#"), F.lpad(shooter, 9, "0")).alias("name_player"),
        F.concat(F.lit("Team "), (key % SHOOTERS % 3).cast("string")).alias("name_team"),
        (key % 5).cast("int").alias("minutes_remaining"),
        (F.col("o_custkey") % 60).cast("int").alias("seconds_remaining"),
        F.col("o_orderpriority").alias("type_event"),
        F.col("o_orderpriority").alias("type_action"),
        F.when(price > 250000, "3PT Field Goal").otherwise("2PT Field Goal").alias("type_shot"),
        F.when(price > 250000, "Above the Break 3").otherwise("Mid-Range").alias("zone_basic"),
        F.when(key % 3 == 0, "Center").otherwise("Left Side").alias("name_zone"),
        F.when(price > 250000, "24+ ft.").otherwise("8-16 ft.").alias("zone_range"),
        F.floor(price / 10000).cast("double").alias("distance_shot"),
        F.lit(True).alias("is_shot_attempted"),
        F.when(F.col("o_orderstatus") == "F", True)
        .when(F.col("o_orderstatus") == "O", False)
        .alias("is_shot_made"),
        F.when(key % 4 == 0, "1 Make").when(key % 4 == 1, "2 Misses").alias("streak_col"),
    )


def supplier_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLAYERS over supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("idPlayer"),
        F.col("s_name").alias("namePlayer"),
        (F.lit(2005) + F.col("s_nationkey")).cast("int").alias("yearSeasonLast"),
        F.concat(F.lit("https://pictures.example/"), F.col("s_suppkey").cast("string")).alias(
            "urlPlayerHeadshot"
        ),
    )


def _entity(player: Column, x: Column, y: Column) -> Column:
    """[team, player, x, y, radius]; the ball has team and player -1."""
    team = F.when(player == -1, F.lit(-1)).otherwise(player % 3)
    return F.array(*[c.cast("double") for c in (team, player, x, y, F.lit(0.0))])


def line_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRACKING over lineitem: a line is a moment of its order with four entities."""
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    ball_x, ball_y = F.col("l_quantity") * 1.5, F.round(F.col("l_discount") * 100)
    entities = F.array(
        _entity(F.lit(-1), ball_x, ball_y),
        _entity(order % SHOOTERS, ball_x + part % 5 * 0.6, ball_y),
        _entity(supp, part * 7 % 94, supp * 3 % 50),
        _entity(part % 61, ball_x + supp % 9, ball_y + part % 4),
    )
    at = lambda n: F.get("entity", n)
    return (
        table(spark, sf_dir, "lineitem")
        .select("*", F.posexplode(entities).alias("slot", "entity"))
        .select(
            at(0).cast("bigint").alias("team_id"),
            at(1).cast("bigint").alias("player_id"),
            at(2).alias("x_loc"),
            at(3).alias("y_loc"),
            at(4).alias("radius"),
            (F.col("l_quantity") * 10 + F.col("l_linenumber") * 0.5).alias("game_clock"),
            F.when(F.col("l_returnflag") != "N", F.round(F.col("l_tax") * 100)).alias("shot_clock"),
            (F.lit(1) + F.col("l_linenumber") % 4).cast("int").alias("quarter"),
            F.concat(F.lit("00"), _game(order)).alias("game_id"),
            order.alias("event_id"),
            F.col("l_linenumber").alias("event_pos"),
            part.cast("int").alias("moment_pos"),
            (supp * 4 + F.col("slot")).cast("int").alias("entity_pos"),
        )
    )


def game_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per order (``value``): an event of three moments and an empty event.

    Urgent orders give a truncated document, and high-priority ones a moment without entities.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    clock = key % 5 * 60 + cust % 60

    def moment(n: int) -> Column:
        x, y = key * 3 % 90, cust * 7 % 48
        rows = F.array(
            _entity(F.lit(-1), x, y),
            _entity(key % SHOOTERS, x + cust % 3 + 0.5 * n, y),
            _entity(cust % 89, x + cust % 11 + n, y + key % 5),
            _entity((key + cust) % 83, x + 2.5 * n, y + cust % 4),
        )
        shot_clock = F.when(key % 4 == 0, F.lit("null")).otherwise((24 - n - key % 4).cast("string"))
        fields = [
            (1 + key % 4).cast("string"),
            F.lit(str(1446000000000 + 40 * n)),
            (clock + 3 - 1.5 * n).cast("string"),
            shot_clock,
            F.lit("null"),
            F.to_json(rows),
        ]
        if n == 2:
            fields[5] = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("null")).otherwise(fields[5])
        return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))

    document = F.concat(
        F.lit('{"gameid":"00'),
        _game(key),
        F.lit('","events":[{"eventId":"'),
        key.cast("string"),
        F.lit('","moments":['),
        F.concat_ws(",", *[moment(n) for n in range(3)]),
        F.lit(']},{"eventId":"-1","moments":[]}]}'),
    )
    cut = F.expr("left(value, length(value) - 9)")
    return (
        table(spark, sf_dir, "orders")
        .withColumn("value", document)
        .select(F.when(F.col("o_orderpriority") == "1-URGENT", cut).otherwise(F.col("value")).alias("value"))
    )


def write_game_logs(spark: SparkSession, sf_dir: str) -> str:
    """``game_log_lines`` as text files, one document per line; returns their new shared folder."""
    path = scratch_path(spark, "logs")
    game_log_lines(spark, sf_dir).write.text(path)
    return path


def game_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game and events: one document per game of the whole lines of ``game_log_lines``."""
    lines = read_game_logs(spark, write_game_logs(spark, sf_dir), layout="lines", files="*.txt")
    whole = lines.where(F.col(schemas.CORRUPT).isNull())
    games = whole.groupBy(F.col("game_id").alias("game")).agg(F.flatten(F.collect_list("events")).alias("events"))
    return cut_lineage(games)


def _write_files(documents: DataFrame, path: str, suffix: str) -> None:
    """A file per row (game, value), in a folder ``game=<id>`` of ``path``, which pyarrow opens.

    Spark's own writers set the mode of each local file by a process, 20 ms a file that cores do not share. A file gets its
    name when it is whole; a task that runs again writes the same names.
    """
    name, where = f"part-{uuid.uuid4().hex}{suffix}", re.sub(r"^file:/+", "/", path)

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(where)
        for game, value in rows:
            folder = f"{root}/game={_folder_value(game)}"
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as file:
                file.write(f"{value}\n".encode())
            store.move(part, f"{folder}/{name}")

    documents.foreachPartition(write)


def _folder_value(value: str | None) -> str:
    """A value as Spark writes it in the name of a folder."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def write_odd_documents(spark: SparkSession, sf_dir: str) -> str:
    """The games' documents as text, one file each in a folder ``game=<id>``; those of every fifth game are cut off.

    Files of the games' own layout, bad ones among them: returns their new shared folder.
    """
    path = scratch_path(spark, "documents")
    cut = F.col("game").cast("long") % 5 == 0
    text = F.when(cut, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    documents = game_documents(spark, sf_dir).withColumn("value", F.to_json(F.struct("game", "events")))
    _write_files(documents.select("game", text.alias("value")), path, ".txt")
    return path


def write_game_documents(documents: DataFrame, path: str) -> None:
    """Adds a JSON file per game to ``path``, in a folder ``game=<id>``."""
    _write_files(documents.select("game", F.to_json(F.struct("events"))), path, ".json")
