"""Make/miss streak that precedes each shot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.session import cut_lineage

# Fixed value: runs of this many or more share a label.
RUN_CAP = 3
NO_STREAK = "0"

# Rows of one group that a single task sorts; a larger group is cut into chunks.
MAX_GROUP_ROWS = 5_000_000
# Sampled rows that place one cut point, and the parts of the hash that samples.
SAMPLES_PER_CHUNK = 64
_SLICES = 1 << 30
# Oversized groups up to this many go out as a broadcast table (a key and the cut points).
MAX_BROADCAST_GROUPS = 10_000


def streak_label(previous: Sequence[Column]) -> Column:
    """Label from the previous results, latest first: "1 Make", "2 Misses", "3+ Makes", ..."""
    cap = len(previous)
    latest = previous[0]

    def text(run: int) -> Column:
        size = f"{run}+" if run == cap else str(run)
        made, missed = ("Make", "Miss") if size == "1" else ("Makes", "Misses")
        return F.when(latest, F.lit(f"{size} {made}")).otherwise(F.lit(f"{size} {missed}"))

    label = F.when(latest.isNull(), F.lit(None).cast("string"))
    for run, earlier in enumerate(previous[1:], start=1):
        label = label.when(~earlier.eqNullSafe(latest), text(run))
    return label.otherwise(text(cap))


def streak_or_zero(streak: str | Column = "streak_col") -> Column:
    """The stored form: "0" where there is no streak."""
    return F.coalesce(F.col(streak) if isinstance(streak, str) else streak, F.lit(NO_STREAK))


def _oversized(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int
) -> tuple[DataFrame, Column] | None:
    """Groups over ``max_rows`` with their cut points, and the chunk of each row; nothing if there are none.

    The cut points are rows of the group at equal steps of a sample, chosen by a hash, as structs of
    all order columns. A row's chunk is the number of cut points not above it: it never falls along
    the order, and only rows equal in all order columns must share it.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    groups = cut_lineage(groups.withColumn("_chunks", 2 * F.ceil(F.col("_n") / F.lit(max_rows))))
    n = groups.count()
    if not n:
        return None
    small = n <= MAX_BROADCAST_GROUPS
    row = F.struct(*order)
    place = F.pmod(F.xxhash64(*order), F.lit(_SLICES)) / F.lit(float(_SLICES))
    sample = (
        df.select(*keys, *order)
        .join(F.broadcast(groups) if small else groups, list(keys))
        .where(place < SAMPLES_PER_CHUNK * F.col("_chunks") / F.col("_n"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(row)).alias("_sample"), F.min("_chunks").alias("_chunks"))
    )
    step = F.size("_sample") / F.col("_chunks")
    at = F.transform(
        F.sequence(F.lit(1), (F.col("_chunks") - 1).cast("int")),
        lambda k: F.get("_sample", F.floor(k * step).cast("int")),
    )
    cuts = cut_lineage(sample.select(*keys, F.filter(at, lambda c: c.isNotNull()).alias("_cuts")))
    chunk = F.when(F.col("_cuts").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c <= row)))
    return F.broadcast(cuts) if small else cuts, chunk


def _carried(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], made: str, cap: int) -> DataFrame:
    """Per chunk of an oversized group, the last ``cap`` results before it, latest first."""
    newest = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        chunked.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= cap)
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_back", made))).alias("_tail"))
        .select(*keys, "_chunk", F.col(f"_tail.{made}").alias("_tail"))
    )
    # One row per chunk, not per shot.
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    none = F.array().cast("array<boolean>")
    before = [F.coalesce(F.lag("_tail", k).over(chunks), none) for k in range(1, cap + 1)]
    return tails.select(*keys, "_chunk", F.slice(F.concat(*before), 1, cap).alias("_carry"))


def label_streaks(
    shots: DataFrame,
    shooter: str = "shooter",
    order: Sequence[str] = ("event_id",),
    made: str = "is_shot_made",
    reset: Sequence[str] = ("game_id",),
    cap: int = RUN_CAP,
    max_group_rows: int = MAX_GROUP_ROWS,
    name: str = "streak_col",
) -> DataFrame:
    """``shots`` with the label of the run that ends before each shot.

    Shots without a known result, shooter or reset value belong to no run: they stay, with a null
    label. Runs restart with each value of ``reset``; the first shot has a null label. A label depends
    on the last ``cap`` results only, so a group with more than ``max_group_rows`` rows is cut along
    its order into chunks of about half as many, each chunk is labelled on its own, and the results just
    before it are carried in from the chunks before. The labels are those of the uncut group.
    """
    keys = [shooter, *reset]
    is_known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [made, *keys]])
    known = shots.where(is_known)
    found = _oversized(known, keys, order, max_group_rows)

    if found is None:
        # the other rows are spread, as they make no runs
        spread = F.when(~is_known, F.xxhash64(*order))
        in_order = Window.partitionBy(*keys, spread).orderBy(*order)
        previous = [F.lag(made, k).over(in_order) for k in range(1, cap + 1)]
        return shots.withColumn(name, F.when(is_known, streak_label(previous)))

    oversized, chunk = found
    # Partitioned by hand: a join on the keys would leave all chunks of a group in one task.
    chunked = (
        known.join(oversized, keys, "left").withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    )
    carried = _carried(
        known.select(*keys, *order, made).join(oversized, keys).withColumn("_chunk", chunk),
        keys, order, made, cap,
    )
    in_order = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    lags = {f"_lag{k}": F.lag(made, k).over(in_order) for k in range(1, cap + 1)}
    numbered = chunked.withColumns({"_row": F.row_number().over(in_order), **lags})
    previous = [
        F.when(F.col("_row") > k, F.col(f"_lag{k}")).otherwise(
            F.get("_carry", F.lit(k) - F.col("_row"))
        )
        for k in range(1, cap + 1)
    ]
    labelled = (
        numbered.join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, streak_label(previous))
        .select(*known.columns, name)
    )
    return labelled.unionByName(shots.where(~is_known).withColumn(name, F.lit(None).cast("string")))
