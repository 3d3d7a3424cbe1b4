"""Game logs to enriched shots as files arrive."""

from __future__ import annotations

import gc
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from rimlight import schemas
from rimlight.functions import court
from rimlight.functions.joins import MAX_BROADCAST_ROWS, counted_side
from rimlight.operators.flatten import flatten_marked
from rimlight.operators.gate import MAX_MISSING
from rimlight.operators.streaks import streak_or_zero
from rimlight.plans.enrich import enrich_games, numeric_shots
from rimlight.session import cut_lineage, scratch_scope, setting
from rimlight.sources.game_logs import LOG_FILES, MALFORMED, in_parts, marked_logs, stream_game_logs
from rimlight.sources.tracking import (
    BATCH,
    latest_events,
    latest_games,
    read_batch,
    read_batches,
    write_batch,
)
from rimlight.streaming.streak_state import carry_streaks, correct_streaks

# Threads of the driver that archive or delete files.
CLEANERS_KEY, CLEANERS = "spark.sql.streaming.fileSource.cleaner.numThreads", 16
# Files of a batch: the driver holds a status, a path and a place in the plan of each, some two kilobytes.
MAX_FILES = 20_000
# Beside the tracking rows: the games of each batch, and those with a malformed document.
GAMES, BAD_GAMES = "_games", "_bad_games"
# Beside the enriched shots: what labels carried from batch to batch need.
STREAKS = "_streaks"
GAME_NAMES = StructType([StructField("game_id", StringType())])


@dataclass(frozen=True)
class IngestPaths:
    """Folders on shared storage."""

    source: str
    tracking: str
    enriched: str
    checkpoint: str


def earlier_tracking(spark: SparkSession, paths: IngestPaths, known: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """The tracking rows of the games in ``known`` (game_id, batch), with their batch.

    Only the folders of the batches named there are scanned: their numbers, few beside the rows, are a literal filter.
    Of all games of these batches (``sent``, if given), those in ``known`` are looked up or the others left out, whichever
    are fewer: where all are known the rows stay where they are.
    """
    batches = [r[0] for r in known.select(BATCH).distinct().collect()]
    every = read_batches(spark, paths.tracking, schemas.MARKED_TRACKING).where(F.col(BATCH).isin(batches))
    rows = every.where(F.col("problem").isNull()).select(*schemas.TRACKING.names, BATCH)
    key, side, how, n = ["game_id", BATCH], known, "left_semi", known.count()
    if sent is not None:
        others = cut_lineage(sent.where(F.col(BATCH).isin(batches)).join(known, key, "left_anti"))
        n_others = others.count()
        if not n_others:
            return rows
        if n_others < n:
            side, how, n = others, "left_anti", n_others
    return rows.join(counted_side(side, n <= MAX_BROADCAST_ROWS), key, how).select(*rows.columns)


def ingest_batch(
    docs: DataFrame,
    batch_id: int,
    paths: IngestPaths,
    shots: DataFrame,
    players: DataFrame,
    max_missing: int = MAX_MISSING,
    malformed: str = "skip_document",
    max_ball_dist: float = court.MAX_BALL_DISTANCE,
    parts: bool = False,
    carry_labels: bool = False,
) -> None:
    """One batch of documents: flatten, enrich, gate, write.

    The JSON is parsed once: the flattened rows go to Parquet without a shuffle, and the enrichment
    reads them from there with pruned columns and pushed filters. A game with parts in earlier
    batches is enriched and gated as a whole, each event by its latest rows. Only the shots of the
    batch's games take part: with batches of up to a few thousand games they are broadcast, and no tracking
    rows but the ball's are shuffled. Each output has a folder per batch: a batch that runs again
    after a failure overwrites its own. With ``parts`` a game may have several documents: with the rule
    ``skip_game`` a malformed event in any of them, of this batch or an earlier one, drops the game. With
    ``carry_labels`` the streaks are labelled here, over all games ingested so far, in place of the labels that ``shots``
    has. What the batch writes to the shared folder on its way is deleted at its end.
    """
    with scratch_scope(docs.sparkSession):
        _ingest_batch(
            docs, batch_id, paths, shots, players, max_missing, malformed, max_ball_dist, parts, carry_labels
        )


def _ingest_batch(
    docs: DataFrame, batch_id: int, paths: IngestPaths, shots: DataFrame, players: DataFrame,
    max_missing: int, malformed: str, max_ball_dist: float, parts: bool, carry_labels: bool,
) -> None:
    write_batch(flatten_marked(marked_logs(docs, malformed)), paths.tracking, batch_id)
    spark = docs.sparkSession
    marked = read_batch(spark, paths.tracking, batch_id, schemas.MARKED_TRACKING)
    now = marked.where(F.col("problem").isNull())
    names = now.select("game_id").distinct()
    bad = None
    if parts and malformed == "skip_game":
        found = marked.where(F.col("problem") == MALFORMED).select("game_id").distinct()
        write_batch(found, f"{paths.tracking}{BAD_GAMES}", batch_id)
        bad = read_batches(spark, f"{paths.tracking}{BAD_GAMES}", GAME_NAMES).where(F.col(BATCH) <= batch_id)
        bad = bad.select("game_id").distinct()
        # a game that this batch spoils has rows in no later batch, nor are its earlier ones its latest
        names = names.unionByName(found).distinct()
    write_batch(names, f"{paths.tracking}{GAMES}", batch_id)
    names = read_batch(spark, f"{paths.tracking}{GAMES}", batch_id, GAME_NAMES)
    tracking = now.select(*schemas.TRACKING.names)
    # games of this batch that came before, in part or whole
    earlier = read_batches(spark, f"{paths.tracking}{GAMES}", GAME_NAMES).where(F.col(BATCH) < batch_id)
    known = cut_lineage(earlier.join(names, "game_id", "left_semi").distinct())
    if not known.isEmpty():
        before = earlier_tracking(spark, paths, known, earlier)
        tracking = latest_events(before.unionByName(tracking.withColumn(BATCH, F.lit(batch_id).cast("bigint"))))
    if bad is not None:
        tracking = tracking.join(bad, "game_id", "left_anti")
    games = names.select(court.game_key("game_id").alias("game_id")).distinct()
    batch_shots = cut_lineage(numeric_shots(shots).join(games, "game_id", "left_semi"))
    if carry_labels:
        state = f"{paths.enriched}{STREAKS}"
        batch_shots = cut_lineage(carry_streaks(batch_shots, state, batch_id, games, "name_player"))
    enriched = enrich_games(tracking, batch_shots, players, max_missing, max_ball_dist=max_ball_dist)
    write_batch(enriched, paths.enriched, batch_id)


def quarantine(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """The documents ingested so far that could not be flattened, and why."""
    rows = read_batches(spark, paths.tracking, schemas.MARKED_TRACKING)
    return rows.where(F.col("problem").isNotNull()).select(BATCH, "game_id", "source_file", "problem")


def ingested_shots(spark: SparkSession, paths: IngestPaths, carry_labels: bool = False) -> DataFrame:
    """The enriched shots ingested so far, each game from the last batch that had it.

    ``carry_labels``, if the batches had it, gives the labels as of now, with late and repeated games.
    """
    sent = read_batches(spark, f"{paths.tracking}{GAMES}", GAME_NAMES)
    sent = sent.select(court.game_key("game_id").alias("game_id"), BATCH)
    latest = latest_games(read_batches(spark, paths.enriched), sent)
    if not carry_labels:
        return latest
    return correct_streaks(latest, f"{paths.enriched}{STREAKS}").withColumn("streak_col", streak_or_zero())


def ingest_games(
    spark: SparkSession,
    paths: IngestPaths,
    shots: DataFrame,
    players: DataFrame,
    layout: str = "file",
    files: str = LOG_FILES,
    id_folder: str | None = None,
    max_files: int | None = None,
    clean_source: str = "off",
    archive_dir: str | None = None,
    **batch_options: object,
) -> StreamingQuery:
    """Start ingesting the files not yet seen; ends when they are done.

    What was seen is kept in the checkpoint, so files need not be removed; ``clean_source`` can
    "archive" or "delete" them once a later batch has run. A batch has ``max_files``, MAX_FILES if none are named. A game
    may span files and batches: the batch that brings more of it enriches and gates all of it.
    """
    options: dict[str, object] = {"cleanSource": clean_source, "maxFilesPerTrigger": max_files or MAX_FILES}
    if archive_dir:
        options["sourceArchiveDir"] = archive_dir
    docs = stream_game_logs(spark, paths.source, layout, files, id_folder, **options)

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, paths, shots, players, parts=in_parts(layout, id_folder), **batch_options)
        # frames in cycles of Python objects keep their plans, and those the files, in the driver's JVM
        gc.collect()

    writer = docs.writeStream.foreachBatch(run).option("checkpointLocation", paths.checkpoint)
    # one thread of Spark's moves some hundred files a second, and its end is not awaited for long
    with setting(spark, CLEANERS_KEY, CLEANERS):
        return writer.trigger(availableNow=True).start()
