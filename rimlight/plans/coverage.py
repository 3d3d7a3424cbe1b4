"""Open-versus-tight table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import court
from rimlight.functions.joins import join_null_safe
from rimlight.functions.numeric import ratio, round_numeric
from rimlight.operators.percentiles import percentile_bands
from rimlight.session import cut_lineage


PARTS = {"all": None, "open": "Open", "tight": "Tight"}


def _shooter_sums(enriched: DataFrame, streak: str, made_threes: bool) -> DataFrame:
    """Everything of a shooter's row in one scan of the shots."""
    after = F.coalesce(F.col("streak_col") == streak, F.lit(False))
    coverage = court.coarse_coverage("closest_defender_distance_bin")
    open_, tight = (F.coalesce(coverage == c, F.lit(False)) for c in ("Open", "Tight"))
    made, attempted = court.flag("is_shot_made"), court.flag("is_shot_attempted")
    three = F.coalesce(court.is_three("type_shot"), F.lit(False)).cast("int")
    if made_threes:
        three = three * made
    known = F.col("is_shot_made").isNotNull() & F.col("is_shot_attempted").isNotNull()

    sums: dict[str, Column] = {
        "total_fga": F.sum(attempted),
        "total_tight": F.count_if(tight & F.col("is_shot_attempted").isNotNull()),
    }
    for part, chosen in (("all", F.lit(True)), ("open", open_), ("tight", tight)):
        rows = known & after & chosen
        sums |= {
            f"n_{part}": F.count_if(rows),
            f"fgm_{part}": F.sum(F.when(rows, made)),
            f"fga_{part}": F.sum(F.when(rows, attempted)),
            f"threes_{part}": F.sum(F.when(rows, three)),
        }
    per_game = enriched.groupBy("shooter", "shooter_team_name", "game_id").agg(
        *[c.alias(n) for n, c in sums.items()],
        F.max(F.when(after, F.col("event_id"))).alias("last_event"),
    )
    latest = F.when(F.col("last_event").isNotNull(), F.struct("game_id", "last_event"))
    return per_game.groupBy("shooter").agg(
        *[F.sum(n).alias(n) for n in sums],
        F.max_by("shooter_team_name", latest).alias("shooter_team_name"),
    )


def _kept_shooter_sums(sums: DataFrame, latest: DataFrame, streak: str, made_threes: bool) -> DataFrame:
    """The same from sums and last events kept by batch (``plans.kept``)."""
    after = F.col("streak_col") == streak
    total = F.sum("attempted")
    values = [
        F.when(F.sum("with_attempt") > 0, total).alias("total_fga"),
        F.coalesce(F.sum(F.when(F.col("coverage") == "Tight", F.col("with_attempt"))), F.lit(0)).alias("total_tight"),
    ]
    for part, coverage in PARTS.items():
        rows = after if coverage is None else after & (F.col("coverage") == coverage)
        values.append(F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0)).alias(f"n_{part}"))
        for name in ("fgm", "fga", "threes"):
            column = "made_threes" if made_threes and name == "threes" else name
            values.append(F.sum(F.when(rows, F.col(column))).alias(f"{name}_{part}"))
    last = F.when(F.col("last_event").isNotNull(), F.struct("game_id", "last_event"))
    teams = latest.where(after).groupBy("shooter").agg(F.max_by("shooter_team_name", last).alias("shooter_team_name"))
    return join_null_safe(sums.groupBy("shooter").agg(*values), teams, ["shooter"], "left")


def coverage_table(
    enriched: DataFrame | tuple[DataFrame, DataFrame],
    streak: str,
    sort: bool = True,
    made_threes: bool = False,
    fill: float | None = 0.0,
) -> DataFrame:
    """Per player with shots after ``streak``: totals, effective FG% open and tight, difference.

    Effective FG% adds half the three-point attempts, or half the makes with ``made_threes``. The
    rate of a coverage without attempts is ``fill``. One scan: everything is summed per (shooter, team,
    game) before the shuffle, in fixed-width buffers, and those rows are folded to one per shooter,
    the team being that of the latest shot after the streak. In place of the shots ``enriched`` can be
    ``kept_coverage``: sums kept by batch.
    """
    summed = isinstance(enriched, tuple)
    sums = _kept_shooter_sums(*enriched, streak, made_threes) if summed else _shooter_sums(enriched, streak, made_threes)
    per_shooter = sums.where(F.col("n_all") > 0)

    def efg(part: str) -> Column:
        value = court.effective_fg(*[F.col(f"{c}_{part}") for c in ("fgm", "threes", "fga")])
        return F.when(F.col(f"n_{part}") == 0, F.lit(fill).cast("double")).otherwise(value)

    def attempts(part: str) -> Column:
        return F.when(F.col(f"n_{part}") == 0, F.lit(0)).otherwise(F.col(f"fga_{part}"))

    table = per_shooter.select(
        "shooter_team_name",
        "shooter",
        "total_fga",
        (attempts("open") + attempts("tight")).alias("streak_fga"),
        ratio(F.col("total_tight"), F.col("total_fga")).alias("percent_fga_tight"),
        efg("all").alias("base_streak_efg"),
        efg("open").alias("efg_open"),
        efg("tight").alias("efg_tight"),
        (efg("tight") - efg("open")).alias("coverage_diff"),
    )
    table = round_numeric(table, 4)
    return table.orderBy(F.col("streak_fga").desc_nulls_last(), "shooter") if sort else table


def coverage_bands(enriched: DataFrame | tuple[DataFrame, DataFrame], streak: str, column: str = "base_streak_efg") -> DataFrame:
    """The coverage table with the percentile band of ``column`` within it."""
    table = cut_lineage(coverage_table(enriched, streak, sort=False))
    return percentile_bands(table, column)
