"""Pages of a sorted table, each found from the last row of the page before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Fixed value: rows of a page.
PAGE_ROWS = 15


class Place(NamedTuple):
    """Where a page ended: its last row's order values, and how many rows equal to it were given."""

    values: tuple
    given: int


def _orders(df: DataFrame, order: Mapping[str, str] | Sequence[str]) -> dict[str, bool]:
    """Column to whether it descends; the other columns follow, ascending, so that only equal rows tie."""
    named = dict(order) if isinstance(order, Mapping) else dict.fromkeys(order, "asc")
    return {c: d == "desc" for c, d in named.items()} | {c: False for c in df.columns if c not in named}


def _after(orders: dict[str, bool], values: tuple) -> Column:
    """Whether a row stands at or after the place, nulls last in each column, as Spark sorts."""
    tests, equal = [], F.lit(True)
    for (name, descending), value in zip(orders.items(), values, strict=True):
        column = F.col(name)
        if value is not None:
            beyond = column < F.lit(value) if descending else column > F.lit(value)
            tests.append(equal & (beyond | column.isNull()))
        equal = equal & (column.isNull() if value is None else F.coalesce(column == F.lit(value), F.lit(False)))
    return reduce(lambda x, y: x | y, tests, equal)


def page(
    df: DataFrame, order: Mapping[str, str] | Sequence[str], after: Place | None = None, size: int = PAGE_ROWS
) -> tuple[list[Row], Place | None]:
    """The next ``size`` rows of ``df`` in the order of ``order`` (names, or name to "asc" or "desc"), and its place.

    The place, given as ``after``, makes the next call give the page that follows; None: nothing follows. Nulls come last
    and ties are settled by the other columns, so pages put together are the sorted table, repeated rows included.
    A page costs one scan in which each task keeps ``size`` rows and those equal to the last row given: nothing is sorted
    whole or skipped row by row. The place is a filter, pushed to the scan of a stored table like any filter on ``df``.
    Columns must have types that sort.
    """
    orders = _orders(df, order)
    given = after.given if after else 0
    rows = df if after is None else df.where(_after(orders, after.values))
    by = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in orders.items()]
    found = rows.orderBy(*by).limit(given + size).collect()
    fresh = found[given:]
    if not fresh:
        return [], None
    key = lambda r: tuple(r[c] for c in orders)
    last = key(fresh[-1])
    again = sum(repr(key(r)) == repr(last) for r in found)
    return fresh, Place(last, again) if len(fresh) == size else None


def page_frame(
    df: DataFrame, order: Mapping[str, str] | Sequence[str], number: int, size: int = PAGE_ROWS
) -> DataFrame:
    """Page ``number``, from 1, reached page by page; ``df`` is read once a page."""
    place, rows = None, []
    for n in range(number):
        rows, place = page(df, order, place, size)
        if place is None:
            rows = rows if n == number - 1 else []
            break
    return df.sparkSession.createDataFrame(rows, df.schema)
