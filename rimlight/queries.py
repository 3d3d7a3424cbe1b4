"""Registered queries: each operator and composite over the whole of a test table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight import adapters, schemas
from rimlight.functions import court, hexgrid, joins, numeric
from rimlight.functions.names import snake_case
from rimlight.operators import coverage, gate, hexbin, pages, percentiles, reshape, streaks, tracking, zones
from rimlight.operators.flatten import flatten_tracking
from rimlight.operators.links import extract_links as links_of
from rimlight.plans import (
    coverage_bands,
    coverage_table,
    enrich_games,
    enrich_shots,
    hex_shot_chart,
    zone_table,
)
from rimlight.plans.enrich import numeric_shots
from rimlight.plans import kept as plans_kept
from rimlight.plans.hexchart import chart_shots
from rimlight.session import cut_lineage, scratch_path
from rimlight.sources import game_logs, layout, tables, versions
from rimlight.sources.kept import replaced_rows
from rimlight.sources import tracking as tracking_io
from rimlight.sources.split_logs import split_logs
from rimlight.streaming.ingest import IngestPaths, ingest_games, ingested_shots
from rimlight.streaming.streak_state import carry_streaks, correct_streaks

Query = Callable[[SparkSession, str], DataFrame]

# Query parameters.
PLAYER = "7"
STREAK = "2 Misses"
SEASONS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _round6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _stored_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shots")
    adapters.order_shots(spark, sf_dir).write.parquet(path)
    return tables.read_shots(spark, path)


def _stored_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "players")
    adapters.supplier_players(spark, sf_dir).write.parquet(path)
    return tables.read_players(spark, path)


# Streaks and scans


@query("streak_labels")
def streak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    return shots.select("event_id", "shooter", streaks.streak_or_zero().alias("streak_col"))


@query("streak_labels_cut")
def streak_labels_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels with every shooter's shots cut into chunks."""
    shots = streaks.label_streaks(
        adapters.event_shots(spark, sf_dir), order=("ts", "event_id"), reset=(), max_group_rows=50
    )
    return shots.select("event_id", "shooter", streaks.streak_or_zero().alias("streak_col"))


def _game_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The unlabelled shots, a day a game, as three batches: every other week, the weeks between with all results of
    some games turned round, and those games again."""
    shots = adapters.event_shots(spark, sf_dir).drop("streak_col")
    shots = cut_lineage(shots.withColumn("game_id", F.unix_date(F.col("ts").cast("date")).cast("bigint")))
    late = F.floor(F.col("game_id") / 7) % 2 == 1
    again = late & (F.col("game_id") % 3 == 0)
    turned = F.col("is_shot_made") != again
    return [shots.where(~late), shots.where(late).withColumn("is_shot_made", turned), shots.where(again)]


@query("streak_labels_batches")
def streak_labels_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels carried over three batches, with late games and games sent again."""
    state, stored = scratch_path(spark, "streaks"), scratch_path(spark, "labelled")
    for batch, shots in enumerate(_game_batches(spark, sf_dir)):
        labelled = carry_streaks(shots, state, batch, order=("ts", "event_id"))
        versions.add_version(labelled, stored, shots, batch)
    shots = correct_streaks(versions.read_versions(spark, stored, labelled.schema), state)
    return shots.select("event_id", "shooter", streaks.streak_or_zero().alias("streak_col"))


@query("streak_label_counts")
def streak_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    return shots.groupBy(streaks.streak_or_zero().alias("streak_col")).agg(
        F.count(F.lit(1)).alias("shots"), F.count_if("is_shot_made").alias("made")
    )


@query("selector_values")
def selector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.selector_values(adapters.event_shots(spark, sf_dir))


@query("selector_seasons")
def selector_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = tables.selector_values(adapters.event_shots(spark, sf_dir))
    return tables.selector_choices(selector, "slug_season")


@query("player_streak_scan")
def player_streak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    return tables.player_streak_shots(shots, PLAYER, SEASONS, STREAK)


@query("league_streak_scan")
def league_streak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.league_streak_shots(adapters.streak_shots(spark, sf_dir), SEASONS, STREAK)


@query("player_base_scan")
def player_base_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    return tables.player_base_shots(shots, PLAYER, None).select(
        "event_id", "slug_season", "is_shot_made", "zone_basic", "zone_range", "name_zone"
    )


@query("season_table_scan")
def season_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "seasons")
    tables.write_streak_shots(adapters.streak_shots(spark, sf_dir), path)
    return tables.league_streak_shots(tables.read_streak_shots(spark, path), SEASONS, STREAK)


@query("coverage_scan")
def coverage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.coverage_shots(adapters.covered_shots(spark, sf_dir), STREAK)


@query("totals_scan")
def totals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.total_shots(adapters.covered_shots(spark, sf_dir))


@query("stored_shots")
def stored_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_shots(spark, sf_dir).select("game_id", "event_id", "name_player", "name_team", "type_shot")


@query("stored_players")
def stored_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_players(spark, sf_dir)


@query("active_players")
def active_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.active_players(adapters.supplier_players(spark, sf_dir))


@query("result_diagnostics")
def result_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.result_diagnostics(adapters.order_shots(spark, sf_dir), "name_team")


# Expressions


@query("shot_columns")
def shot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_shots(spark, sf_dir).select(
        "event_id",
        court.court_x("location_x").alias("loc_x"),
        court.court_y("location_y").alias("loc_y"),
        court.flag("is_shot_made").alias("shot_made_numeric"),
        court.made_label("is_shot_made").alias("shot_made_flag"),
        court.flag("is_shot_attempted").alias("shot_attempted_flag"),
        court.value_by_type("type_shot").alias("type_value"),
        court.value_by_zone("zone_basic").alias("zone_value"),
        court.zone_rank("zone_range").alias("zone_rank"),
        court.is_three("type_shot").alias("is_three"),
    )


@query("tracking_columns")
def tracking_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.line_tracking(spark, sf_dir)
    names = tracking.player_names(adapters.supplier_players(spark, sf_dir))
    named = frames.join(names, "player_id", "left")
    hoop = court.distance(court.fold_half_court("x_loc"), F.col("y_loc"), F.lit(5.25), F.lit(25.0))
    return _round6(
        named.select(
            court.game_key("game_id").alias("game_id"),
            "event_id",
            "event_pos",
            "moment_pos",
            "entity_pos",
            court.entity_name("player_id", "entity_name").alias("name_player"),
            court.fold_half_court("x_loc").alias("x_loc"),
            hoop.alias("hoop_dist"),
            court.coverage_bin(hoop / 4).alias("bin"),
            court.coarse_coverage(court.coverage_bin(hoop / 4)).alias("coverage"),
        ),
        "x_loc",
        "hoop_dist",
    )


@query("shot_clocks")
def shot_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.order_shots(spark, sf_dir).select(
        "event_id",
        court.shot_game_clock("minutes_remaining", "seconds_remaining").alias("shot_game_clock"),
        streaks.streak_or_zero().alias("streak_col"),
    )


@query("number_columns")
def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    df = adapters.table(spark, sf_dir, "events").select(
        "event_id",
        numeric.clamp(value / 100 - 1, -0.15, 0.15).alias("bounded_diff"),
        numeric.ratio(value, F.col("event_id") % 5).alias("safe_ratio"),
        hexgrid.lower_bound(value).alias("low_bound"),
        hexgrid.upper_bound(value).alias("high_bound"),
        numeric.round_to(value / 7, 2).alias("two_digits"),
        F.round(hexgrid.radius_factor(F.floor(value), F.lit(500)), 6).alias("radius_factor"),
    )
    return numeric.round_numeric(df, 4)


# Zones


@query("zone_vs_league")
def zone_vs_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    compared = zones.zone_comparison(shots, STREAK, scope="league")
    return _round6(
        compared, "zone_pct", "zone_points_per_shot", "league_pct", "league_pps"
    )


@query("zone_rates")
def zone_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.event_shots(spark, sf_dir)
    return _round6(zones.zone_stats(shots, ["slug_season"]), "zone_pct", "zone_points_per_shot")


@query("base_zone_rates")
def base_zone_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.event_shots(spark, sf_dir)
    return _round6(zones.base_zone_stats(shots, ["slug_season"]), "league_pct", "league_pps")


@query("zone_table_league")
def zone_table_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_table(adapters.streak_shots(spark, sf_dir), STREAK, PLAYER, scope="league")


@query("zone_table_self")
def zone_table_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = zone_table(adapters.streak_shots(spark, sf_dir), STREAK, PLAYER, scope="self")
    return _round6(table, "streak_diff")


@query("zone_tables_league")
def zone_tables_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_table(adapters.streak_shots(spark, sf_dir), STREAK, seasons=SEASONS, scope="league")


@query("zone_tables_self")
def zone_tables_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.streak_shots(spark, sf_dir)
    return _round6(zone_table(shots, STREAK, seasons=SEASONS, scope="self"), "streak_diff")


# Hexagons


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = court.flag("is_shot_made")
    return adapters.event_shots(spark, sf_dir).select(
        "shooter",
        "zone_range",
        "name_zone",
        court.court_x("location_x").alias("loc_x"),
        court.court_y("location_y").alias("loc_y"),
        F.lit(1).alias("attempts"),
        made.alias("made"),
        (made * court.value_by_type("type_shot")).alias("points"),
    )


@query("hex_cells")
def hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hexbin.with_hex_cell(_located(spark, sf_dir), by=["shooter"])
    counts = cells.groupBy("shooter", *hexbin.HEX).agg(F.count(F.lit(1)).alias("attempts"))
    return _round6(counts, "x0", "y0")


@query("hex_cells_all")
def hex_cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = hexbin.hex_stats(hexbin.with_hex_cell(_located(spark, sf_dir)))
    return _round6(stats, "x0", "y0", "hex_pct", "hex_points_per_shot")


@query("hex_cells_fixed")
def hex_cells_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hexbin.with_hex_cell(_located(spark, sf_dir), origin=(-25.0, 0.0))
    return hexbin.hex_zone_counts(cells)


@query("hex_dominant_zone")
def hex_dominant_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hexbin.with_hex_cell(_located(spark, sf_dir), by=["shooter"])
    return _round6(hexbin.dominant_zone(cells, ["shooter"]), "x0", "y0")


@query("hex_corners")
def hex_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = hexbin.hex_stats(hexbin.with_hex_cell(_located(spark, sf_dir)))
    corners = hexbin.hex_vertices(stats)
    return _round6(
        corners.select(*hexgrid.CELL, "corner", "center_x", "center_y", "x", "y"),
        "center_x",
        "center_y",
        "x",
        "y",
    )


_CHART = [
    "zone_range",
    "name_zone",
    "hex_attempts",
    "corner",
    "radius_factor",
    "adj_x",
    "adj_y",
    "bounded_fg_diff",
    "bounded_fg_pct",
    "bounded_points_per_shot",
]


def _chart(df: DataFrame) -> DataFrame:
    measures = [c for c in _CHART if c not in ("zone_range", "name_zone", "hex_attempts", "corner")]
    return _round6(df.select("shooter", *hexgrid.CELL, *_CHART), *measures)


@query("hex_chart")
def hex_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chart(hex_shot_chart(adapters.stored_streak_shots(spark, sf_dir), STREAK, scope="league"))


@query("hex_chart_self")
def hex_chart_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chart(hex_shot_chart(adapters.stored_streak_shots(spark, sf_dir), STREAK, scope="self"))


@query("hex_chart_player")
def hex_chart_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.stored_streak_shots(spark, sf_dir)
    return _chart(hex_shot_chart(shots, STREAK, PLAYER, scope="league"))


@query("chart_rows")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_shots(adapters.streak_shots(spark, sf_dir), STREAK)


# Coverage and percentiles


@query("coverage_table")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_table(adapters.covered_shots(spark, sf_dir), STREAK)


@query("coverage_page")
def coverage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the coverage table, from the end of the first."""
    table = cut_lineage(coverage_table(adapters.covered_shots(spark, sf_dir), STREAK, sort=False))
    return pages.page_frame(table, {"streak_fga": "desc", "shooter": "asc"}, 2)


@query("coverage_totals")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(coverage.coverage_totals(adapters.covered_shots(spark, sf_dir)), "percent_fga_tight")


@query("streak_efg")
def streak_efg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(coverage.streak_efg(adapters.covered_shots(spark, sf_dir), STREAK), "base_streak_efg")


@query("coverage_efg")
def coverage_efg(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = coverage.coverage_efg(adapters.covered_shots(spark, sf_dir), STREAK)
    return _round6(table, "fg_percent", "efg_percent")


@query("coverage_pivot")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = coverage.coverage_pivot(adapters.covered_shots(spark, sf_dir), STREAK)
    return _round6(wide, "efg_percent_open", "efg_percent_tight")


@query("shooter_teams")
def shooter_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.shooter_teams(adapters.covered_shots(spark, sf_dir), STREAK)


@query("coverage_percentile_bands")
def coverage_percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = coverage_bands(adapters.covered_shots(spark, sf_dir), STREAK)
    return bands.select("shooter", "base_streak_efg", "band")


@query("percentile_breaks")
def percentile_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(
        percentiles.percentile_breaks(adapters.table(spark, sf_dir, "events"), "value"), "breakpoint"
    )


@query("percentile_bands")
def percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").select("event_id", "value")
    return percentiles.percentile_bands(events, "value")


# Sums kept by batch


def _resent(games: DataFrame, wrong: Column) -> list[DataFrame]:
    """Labelled shots in three batches: games of even number, those of odd number with some of them all made and
    labelled wrong, and the latter again."""
    odd, again = F.col("game_id") % 2 == 1, F.col("game_id") % 3 == 0
    turned = games.where(odd).withColumns(
        {"is_shot_made": again | F.col("is_shot_made"), "streak_col": F.when(again, wrong).otherwise(F.col("streak_col"))}
    )
    return [games.where(~odd), turned, games.where(odd & again)]


def _keep(spark: SparkSession, batches: list[DataFrame], keep: Callable) -> None:
    """Stores each batch, and calls ``keep`` with its number, its shots and those it replaces."""
    stored = scratch_path(spark, "kept-shots")
    for batch, shots in enumerate(batches):
        removed = replaced_rows(spark, stored, shots.schema, batch, shots)
        keep(batch, shots, removed)
        versions.add_version(shots, stored, shots, batch)


def _kept_zone_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, shots = scratch_path(spark, "zone-sums"), adapters.streak_shots(spark, sf_dir)
    games = cut_lineage(shots.withColumn("game_id", F.unix_date(F.col("ts").cast("date")).cast("bigint")))
    _keep(spark, _resent(games, F.lit(STREAK)), lambda batch, *rows: plans_kept.keep_zones(path, batch, *rows))
    return plans_kept.kept_zones(spark, path)


@query("zone_tables_league_kept")
def zone_tables_league_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_table(_kept_zone_sums(spark, sf_dir), STREAK, seasons=SEASONS, scope="league", summed=True)


@query("zone_tables_self_kept")
def zone_tables_self_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _kept_zone_sums(spark, sf_dir)
    return _round6(zone_table(sums, STREAK, seasons=SEASONS, scope="self", summed=True), "streak_diff")


@query("coverage_table_kept")
def coverage_table_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches made one before the third."""
    path, games = scratch_path(spark, "coverage-sums"), cut_lineage(adapters.covered_shots(spark, sf_dir))

    def keep(batch: int, *rows: DataFrame) -> None:
        if batch == 2:
            plans_kept.compact_kept(spark, coverage=path)
        plans_kept.keep_coverage(path, batch, *rows)

    _keep(spark, _resent(games, F.lit(STREAK)), keep)
    return coverage_table(plans_kept.kept_coverage(spark, path), STREAK)


@query("percentile_breaks_kept")
def percentile_breaks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values over five batches; the first two are wrong and taken back by the last."""
    path, events = scratch_path(spark, "value-counts"), adapters.table(spark, sf_dir, "events")
    parts = [events.where(F.pmod("event_id", F.lit(4)) == k) for k in range(4)]
    wrong = [p.withColumn("value", F.round("value")) for p in parts[:2]]
    for batch, rows in enumerate([*wrong, *parts[2:]]):
        plans_kept.keep_values(path, batch, "value", rows)
    plans_kept.keep_values(path, 4, "value", parts[0].unionByName(parts[1]), wrong[0].unionByName(wrong[1]))
    return _round6(percentiles.breaks_of_counts(plans_kept.kept_values(spark, path)), "breakpoint")


# Tracking


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        tracking.half_court(adapters.line_tracking(spark, sf_dir)),
        numeric_shots(adapters.order_shots(spark, sf_dir)),
        adapters.supplier_players(spark, sf_dir),
    )


@query("ball_positions")
def ball_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.ball_positions(_frames(spark, sf_dir)[0])


@query("release_frame")
def release_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = tracking.release_frames(*_frames(spark, sf_dir))
    return _round6(
        released, "shooter_x_loc", "shooter_y_loc", "ball_x_loc", "ball_y_loc", "dist_to_ball"
    )


def _opponents(nearest: DataFrame) -> DataFrame:
    return _round6(
        nearest.select(
            *tracking.SHOT_KEY,
            "shooter",
            "closest_player",
            "distance_to_shooter",
            "closest_defender_distance_bin",
        ),
        "distance_to_shooter",
    )


@query("nearest_opponent")
def nearest_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, shots, players = _frames(spark, sf_dir)
    frames = layout.lay_out_for(frames, shots, joins.MAX_BROADCAST_ROWS)
    released = tracking.release_frames(frames, shots, players)
    return _opponents(tracking.nearest_opponents(frames, released, players))


@query("release_frame_merge")
def release_frame_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``release_frame`` with nothing broadcast: tracking laid out by event."""
    released = tracking.release_frames(*_frames(spark, sf_dir), max_broadcast=0)
    return _round6(
        released, "shooter_x_loc", "shooter_y_loc", "ball_x_loc", "ball_y_loc", "dist_to_ball"
    )


@query("nearest_opponent_merge")
def nearest_opponent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``nearest_opponent`` over a stored layout, with events of more than 20 rows as hot ones."""
    frames, shots, players = _frames(spark, sf_dir)
    path = scratch_path(spark, "layout")
    layout.write_layout(frames, path, max_event_rows=20, slices=4)
    laid = layout.read_layout(spark, path)
    released = tracking.release_frames(laid, shots, players, max_broadcast=0)
    return _opponents(tracking.nearest_opponents(laid, released, players, max_broadcast=0))


@query("enriched_shots_merge")
def enriched_shots_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = enrich_shots(
        adapters.line_tracking(spark, sf_dir),
        adapters.order_shots(spark, sf_dir),
        adapters.supplier_players(spark, sf_dir),
        max_broadcast=0,
    )
    return _round6(enriched, "distance_to_shooter")


@query("enriched_shots")
def enriched_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = enrich_shots(
        adapters.line_tracking(spark, sf_dir),
        adapters.order_shots(spark, sf_dir),
        adapters.supplier_players(spark, sf_dir),
    )
    return _round6(enriched, "distance_to_shooter")


@query("quality_gate")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = enrich_games(
        adapters.line_tracking(spark, sf_dir),
        adapters.order_shots(spark, sf_dir),
        adapters.supplier_players(spark, sf_dir),
    )
    return _round6(gated, "distance_to_shooter")


@query("game_coverage")
def game_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.order_shots(spark, sf_dir)
    return gate.game_coverage(shots.where("is_shot_made"), shots)


# Ingest and storage


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = adapters.write_game_logs(spark, sf_dir)
    return game_logs.read_game_logs(spark, path, layout="lines", files="*.txt")


@query("flatten_nested")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_tracking(game_logs.usable_logs(_logs(spark, sf_dir)))


@query("flatten_good_events")
def flatten_good_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten_tracking(game_logs.usable_logs(_logs(spark, sf_dir), malformed="skip_event"))
    return rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("entity_rows"), F.countDistinct("event_id").alias("game_events")
    )


@query("log_problems")
def log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = game_logs.quarantined_logs(_logs(spark, sf_dir))
    return bad.groupBy("problem", "game_id").agg(F.count(F.lit(1)).alias("documents"))


@query("tracking_csv")
def tracking_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tracking")
    tracking_io.write_tracking(adapters.line_tracking(spark, sf_dir), path, fmt="csv")
    return _round6(tracking_io.read_tracking_csv(spark, path), "x_loc", "y_loc")


def _sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.covered_shots(spark, sf_dir)
    every = reshape.union_filled(shots, spark.createDataFrame([], schemas.ENRICHED))
    return cut_lineage(every.select(*schemas.ENRICHED.names))


def _sink(spark: SparkSession, path: str) -> DataFrame:
    return tracking_io.read_enriched(spark, path).select(
        "game_id", "event_id", "streak_col", "shooter", "type_shot", "closest_defender_distance_bin"
    )


@query("enriched_sink")
def enriched_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: replacing the games leaves each shot once."""
    rows, path = _sink_rows(spark, sf_dir), scratch_path(spark, "enriched")
    tracking_io.write_enriched(rows, path)
    tracking_io.write_enriched(rows, path)
    return _sink(spark, path)


@query("enriched_sink_append")
def enriched_sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of each game's shots appended; the second write is run again under its number."""
    rows, path = _sink_rows(spark, sf_dir), scratch_path(spark, "enriched")
    for version in (0, 1, 1):
        half = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == version)
        tracking_io.write_enriched(half, path, mode="append", version=version)
    return _sink(spark, path)


@query("enriched_sink_compacted")
def enriched_sink_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the games wrong at first, compacted, replaced, compacted again; what is left over deleted."""
    rows, path = _sink_rows(spark, sf_dir), scratch_path(spark, "enriched")
    some = F.pmod(F.xxhash64("game_id"), F.lit(2)) == 0
    tracking_io.write_enriched(rows.where(~some | some.isNull()), path, mode="append")
    tracking_io.write_enriched(rows.where(some).withColumn("streak_col", F.lit("wrong")), path)
    tracking_io.compact_enriched(spark, path)
    tracking_io.write_enriched(rows.where(some), path)
    tracking_io.compact_enriched(spark, path)
    versions.vacuum(spark, path)
    return _sink(spark, path)


def _ingest_paths(spark: SparkSession, source: str) -> IngestPaths:
    root = scratch_path(spark, "ingest")
    return IngestPaths(source, f"{root}/tracking", f"{root}/enriched", f"{root}/checkpoint")


def _ingest(spark: SparkSession, sf_dir: str, paths: IngestPaths, **options: object) -> None:
    ingest_games(
        spark,
        paths,
        adapters.order_shots(spark, sf_dir),
        adapters.supplier_players(spark, sf_dir),
        layout="lines",
        files="*.txt",
        **options,
    ).awaitTermination()


def _halves(spark: SparkSession, sf_dir: str, key: Column) -> list[DataFrame]:
    """The game log lines in two halves by ``key``; the lines are made once."""
    lines = cut_lineage(adapters.game_log_lines(spark, sf_dir).withColumn("half", F.crc32(key.cast("binary")) % 2))
    return [lines.where(F.col("half") == half).select("value") for half in (0, 1)]


@query("ingest_carried_labels")
def ingest_carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the games after the other half; the streaks are labelled on the way, over all games."""
    paths = _ingest_paths(spark, scratch_path(spark, "logs"))
    game = F.coalesce(F.get_json_object("value", "$.gameid"), "value")
    for lines in _halves(spark, sf_dir, game):
        lines.write.mode("append").text(paths.source)
        _ingest(spark, sf_dir, paths, carry_labels=True)
    return _round6(ingested_shots(spark, paths, carry_labels=True), "distance_to_shooter")


@query("ingest_two_batches")
def ingest_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's lines arrive in two runs; the second enriches and gates the whole games."""
    paths = _ingest_paths(spark, scratch_path(spark, "logs"))
    for lines in _halves(spark, sf_dir, F.col("value")):
        lines.write.mode("append").text(paths.source)
        _ingest(spark, sf_dir, paths)
    return _round6(ingested_shots(spark, paths), "distance_to_shooter")


@query("ingest_games")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _ingest_paths(spark, adapters.write_game_logs(spark, sf_dir))
    _ingest(spark, sf_dir, paths)
    return _round6(ingested_shots(spark, paths), "distance_to_shooter")


@query("flatten_documents")
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per file, files of the default names; an event's place is within its game."""
    path = scratch_path(spark, "documents")
    adapters.write_game_documents(adapters.game_documents(spark, sf_dir), path)
    docs = game_logs.read_game_logs(spark, path, id_folder="game")
    return flatten_tracking(game_logs.usable_logs(docs, malformed="skip_event")).drop("event_pos")


@query("flatten_odd_documents")
def flatten_odd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per file, some of them cut off: these give no rows."""
    docs = game_logs.read_game_logs(spark, adapters.write_odd_documents(spark, sf_dir), files="*.txt", id_folder="game")
    return flatten_tracking(game_logs.usable_logs(docs, malformed="skip_event")).drop("event_pos")


@query("flatten_split_documents")
def flatten_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files cut at their events, which tasks share."""
    path = adapters.write_odd_documents(spark, sf_dir)
    docs = split_logs(spark, path, malformed="skip_event", files="*.txt", id_folder="game")
    return flatten_tracking(docs.where("problem is null")).drop("event_pos")


@query("split_document_problems")
def split_document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are cut off, one row each, as quarantined, and how many events the others hold."""
    path = adapters.write_odd_documents(spark, sf_dir)
    docs = split_logs(spark, path, malformed="skip_event", files="*.txt", id_folder="game")
    return docs.groupBy("game_id", "problem").agg(F.sum(F.coalesce(F.size("events"), F.lit(0))).alias("events"))


@query("ingest_documents")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per file, in two runs; files are archived once a later run has ended."""
    paths = _ingest_paths(spark, scratch_path(spark, "documents"))
    archive = scratch_path(spark, "archive")
    documents = adapters.game_documents(spark, sf_dir)
    shots, players = _stored_shots(spark, sf_dir), _stored_players(spark, sf_dir)
    for half in (0, 1):
        adapters.write_game_documents(documents.where(F.crc32(F.col("game").cast("binary")) % 2 == half), paths.source)
        ingest_games(
            spark,
            paths,
            shots,
            players,
            id_folder="game",
            clean_source="archive",
            archive_dir=archive,
            malformed="skip_event",
        ).awaitTermination()
    return _round6(ingested_shots(spark, paths), "distance_to_shooter")


@query("extract_links")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(adapters.table(spark, sf_dir, "pages"))


@query("extract_links_rewritten")
def extract_links_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(
        adapters.table(spark, sf_dir, "pages"),
        contains="e",
        drop="/th",
        prefix="https://host.example",
        extension="er",
    )


@query("union_filled")
def union_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = adapters.event_shots(spark, sf_dir).select("event_id", "shooter", "zone_range")
    orders = adapters.order_shots(spark, sf_dir).select("event_id", "name_team", "zone_range")
    both = reshape.union_filled(shots, orders)
    present: Callable[[str], Column] = lambda c: F.count(c).alias(f"{c}_rows")
    return both.groupBy("zone_range").agg(present("event_id"), present("shooter"), present("name_team"))


@query("snake_names")
def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snake_case(adapters.supplier_players(spark, sf_dir))
