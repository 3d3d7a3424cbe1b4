"""Shooting by defensive coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import court
from rimlight.functions.numeric import ratio
from rimlight.operators.ranking import last_per_group
from rimlight.operators.reshape import pivot_wide
from rimlight.sources.tables import coverage_shots, known_results, total_shots

COVERAGES = ["Open", "Tight"]


# What sums kept by batch (``sources.kept``) are keyed by.
COVERAGE_KEYS = ["shooter", "streak_col", "coverage"]
COVERAGE_SUMS = ["shots", "with_attempt", "attempted", "n", "fgm", "fga", "threes", "made_threes"]


def coverage_measures() -> dict[str, Column]:
    """What a shot adds to the sums of the coverage table, all whole numbers; null counts as 0."""
    made, attempted = court.flag("is_shot_made"), court.flag("is_shot_attempted")
    known = F.col("is_shot_made").isNotNull() & F.col("is_shot_attempted").isNotNull()
    three = F.coalesce(court.is_three("type_shot"), F.lit(False)).cast("int")
    results = [F.when(known, value) for value in (F.lit(1), made, attempted, three, three * made)]
    values = [F.lit(1), attempted.isNotNull().cast("int"), attempted, *results]
    return dict(zip(COVERAGE_SUMS, values, strict=True))


def _shooting_sums() -> list[Column]:
    return [
        F.sum(court.flag("is_shot_made")).alias("fgm"),
        F.sum(court.flag("is_shot_attempted")).alias("fga"),
        F.count_if(court.is_three("type_shot")).alias("threes"),
    ]


def _efg(prefix: str = "") -> Column:
    return court.effective_fg(*[F.col(f"{prefix}{c}") for c in ("fgm", "threes", "fga")])


def coverage_totals(enriched: DataFrame) -> DataFrame:
    """Per shooter over all streaks: attempts, tight attempts and their share."""
    tight = court.coarse_coverage("closest_defender_distance_bin") == "Tight"
    return (
        total_shots(enriched.where(F.col("is_shot_attempted").isNotNull()))
        .groupBy("shooter")
        .agg(
            F.sum(court.flag("is_shot_attempted")).alias("total_fga"),
            F.count_if(tight).alias("total_tight_attempts"),
        )
        .withColumn("percent_fga_tight", ratio(F.col("total_tight_attempts"), F.col("total_fga")))
    )


def streak_efg(enriched: DataFrame, streak: str) -> DataFrame:
    """Per shooter: effective FG% after ``streak``."""
    sums = known_results(coverage_shots(enriched, streak)).groupBy("shooter", "streak_col")
    return sums.agg(*_shooting_sums()).withColumn("base_streak_efg", _efg())


def coverage_efg(enriched: DataFrame, streak: str) -> DataFrame:
    """Per shooter and coverage: FG% and effective FG% after ``streak``."""
    return (
        known_results(coverage_shots(enriched, streak))
        .withColumn("coverage", court.coarse_coverage("closest_defender_distance_bin"))
        .groupBy("shooter", "streak_col", "coverage")
        .agg(*_shooting_sums())
        .withColumns({"fg_percent": ratio(F.col("fgm"), F.col("fga")), "efg_percent": _efg()})
    )


def coverage_pivot(enriched: DataFrame, streak: str) -> DataFrame:
    """Per shooter: effective FG% and attempts in open and tight shots side by side, 0 if none."""
    return pivot_wide(
        coverage_efg(enriched, streak),
        ["shooter"],
        "coverage",
        COVERAGES,
        {"efg_percent": F.first("efg_percent"), "fga": F.first("fga")},
    )


def shooter_teams(enriched: DataFrame, streak: str) -> DataFrame:
    """Team of each shooter's latest shot after ``streak``."""
    rows = enriched.where(F.col("streak_col") == streak).select(
        "shooter", "shooter_team_name", "game_id", "event_id"
    )
    return last_per_group(rows, ["shooter"], ["game_id", "event_id"]).select("shooter", "shooter_team_name")
