"""Join helpers: null-safe keys, and a join strategy that follows from a counted size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of the few narrow columns joined to tracking rows: some hundred MB at most.
MAX_BROADCAST_ROWS = 1_000_000


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows. Counts them, one row per task; for narrow and cheap frames."""
    return df.count() <= max_rows


def counted_side(df: DataFrame, small: bool) -> DataFrame:
    """``df`` marked for a broadcast if ``small``, else for a sort-merge join.

    The other side, tracking rows, is big in either case. Spark's own estimate can take it for the
    smaller one, as it does not see how far a compressed or exploded row unfolds.
    """
    return F.broadcast(df) if small else df.hint("merge")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null keys match; the left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_{k}" for k in keys])
