"""Game documents cut at their events, so that one large file feeds several tasks.

The text source reads a file in splits and cuts it at a mark, the key of an event's id. A piece holds what follows a mark
up to the next one: the rest of an event and the head of the next. Put between the heads and tails it lacks, each
piece is a document of its own, so the JSON parser tells whether it is sound; the file is sound if all its pieces are and
the first opens and the last closes the document. A task holds one event at a time instead of one game.

The mark cannot stand inside a JSON string, where its quotes would be escaped. The id must come before the moments of its
event, as the logs have it; documents written otherwise are set aside under a problem of their own and can be read
with ``game_logs``. Compressed files are read by one task each, piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimlight import schemas
from rimlight.functions.joins import counted_side, fits_broadcast
from rimlight.session import cut_lineage
from rimlight.sources import game_logs

MARK = '"eventId"'
LATE_ID = "moments before the event id"
# A document has the first that one of its pieces has.
PROBLEMS = [game_logs.CORRUPT_DOCUMENT, game_logs.NO_EVENTS, LATE_ID, game_logs.MALFORMED]
_SPACES = " \t\r\n"
# Blocks, each with the path of its file, that go to every task; 30 TB in blocks of 128 MB.
MAX_PLACES = 250_000


def _pieces(spark: SparkSession, path: str, files: str, id_folder: str | None) -> DataFrame:
    """One row per piece: where it stands, whether it opens or closes a document, and what it parses to."""
    text = F.btrim("value", F.lit(_SPACES))
    reader = spark.read.options(**game_logs.folder_options(id_folder))
    scan = reader.option("lineSep", MARK).option("pathGlobFilter", files).text(path)
    rows = scan.select(
        game_logs.game_of_file(id_folder).alias("game_id"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        # pieces of a block are read one after another by one task
        F.monotonically_increasing_id().alias("id"),
        "value",
        # what follows a mark begins with the colon of the id; the head of an event never ends with a brace
        (F.left(text, F.lit(1)) != ":").alias("opens"),
        (F.right(text, F.lit(1)) == "}").alias("closes"),
    )
    begin = F.when(F.col("opens"), F.lit("")).otherwise(F.lit('{"events":[{' + MARK))
    end = F.when(F.col("closes"), F.lit("")).otherwise(F.lit(MARK + ":null}]}"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    parsed = F.from_json(F.concat(begin, "value", end), schemas.GAME_DOCUMENT, options)
    return rows.withColumn("parsed", parsed).drop("value")


def _piece_problem(malformed: str) -> tuple[Column, Column]:
    """(events of a piece without the open end, the place in ``PROBLEMS`` of what is wrong with the piece)."""
    events = F.col("parsed.events")
    before = F.size(events) - 1
    last = F.get(events, before)
    whole = F.when(F.col("closes"), events).otherwise(F.slice(events, F.lit(1), F.greatest(before, F.lit(0))))
    # a piece that does not close its document ends with the event that was put to it
    least = F.when(F.col("opens"), 1).otherwise(2)
    unsound = ~F.col("closes") & ((F.size(events) < least) | last.isNull() | last["eventId"].isNotNull())
    problem = (
        F.when(F.col(f"parsed.{schemas.CORRUPT}").isNotNull() | F.coalesce(unsound, F.lit(True)), 0)
        .when(events.isNull(), 1)
        .when(~F.col("closes") & last["moments"].isNotNull(), 2)
    )
    if malformed != "skip_event":
        bad = F.exists(whole, lambda e: F.coalesce(game_logs.bad_event(e), F.lit(True)))
        problem = problem.when(bad, 3)
    return whole, problem


def split_logs(
    spark: SparkSession,
    path: str,
    malformed: str = "skip_document",
    files: str = game_logs.LOG_FILES,
    id_folder: str | None = None,
) -> DataFrame:
    """The documents under ``path``, an event a row: game_id, source_file, problem, events, first_event.

    For ``flatten_tracking`` and ``flatten_marked``, which give the rows of ``game_logs`` with the same rule; ``first_event`` is the place
    of the row's first event in its document. A document with a problem is one row without events. Where
    ``skip_event`` drops events, the places of the others keep their order and leave gaps. The pieces are parsed once, when
    this is called, and written to the shared folder.
    """
    if malformed not in ("skip_document", "skip_event", "skip_game"):
        raise ValueError(f"unknown rule {malformed!r}")
    pieces = cut_lineage(_pieces(spark, path, files, id_folder))
    whole, problem = _piece_problem(malformed)
    pieces = pieces.withColumns({"events": whole, "wrong": problem}).drop("parsed")
    # numbers only, so that they are summed by hash before the shuffle
    blocks = cut_lineage(
        pieces.groupBy("source_file", "game_id", "block").agg(
            F.count("*").alias("n"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.count_if("opens").alias("opens"),
            F.count_if("closes").alias("closes"),
            F.min(F.when(F.col("opens"), F.col("id"))).alias("open_id"),
            F.max(F.when(F.col("closes"), F.col("id"))).alias("close_id"),
            F.min("wrong").alias("wrong"),
        )
    )
    first, last = F.min_by(F.struct("first_id", "open_id"), "block"), F.max_by(F.struct("last_id", "close_id"), "block")
    ends = first["first_id"].eqNullSafe(first["open_id"]) & last["last_id"].eqNullSafe(last["close_id"])
    documents = blocks.groupBy("source_file", "game_id").agg(
        F.min("wrong").alias("wrong"), ((F.sum("opens") == 1) & (F.sum("closes") == 1) & ends).alias("sound")
    )
    wrong = F.when(F.col("sound"), F.col("wrong")).otherwise(0)
    named = F.get(F.array(*map(F.lit, PROBLEMS)), wrong)
    found = F.when((wrong == 0) | F.col("game_id").isNotNull(), named).otherwise(F.lit(game_logs.NO_GAME))
    documents = documents.select(F.col("source_file").alias("_file"), "game_id", found.alias("problem"))
    gone = F.lit(False)
    if malformed == "skip_game":
        # a game may have several files: one with a malformed event drops them all
        games = Window.partitionBy("game_id")
        gone = F.coalesce(F.max(F.col("problem") == game_logs.MALFORMED).over(games) & F.col("problem").isNull(), F.lit(False))
    documents = documents.withColumn("gone", gone).drop("game_id")
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.select(
        F.col("source_file").alias("_file"),
        F.col("block").alias("_block"),
        # the first piece of a document is its head, without an event
        (F.coalesce(before, F.lit(0)) - F.col("first_id") - 1).alias("shift"),
    )
    places = cut_lineage(places.join(documents, "_file").where(~F.col("gone")))
    places = counted_side(places, fits_broadcast(places, MAX_PLACES))
    same = (F.col("source_file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    rows = pieces.join(places, same).withColumn("first_event", F.greatest(F.col("id") + F.col("shift"), F.lit(0)).cast("int"))
    # of a document with a problem its head stays, or what stands in its place
    rows = rows.where(F.col("problem").isNull() | (F.col("id") + F.col("shift") == -1))
    kept = F.when(F.col("problem").isNull(), game_logs.kept_events(malformed))
    return rows.select("game_id", "source_file", "problem", kept.alias("events"), "first_event")
