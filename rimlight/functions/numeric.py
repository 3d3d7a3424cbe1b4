"""Null-propagating clamp, safe ratio, decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` held in [low, high]; null stays null (least/greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding of the value's six-place decimal, as a double.

    Rounding a binary double directly depends on the engine's text form of it; going through a
    decimal makes the result the same everywhere. What the decimal cannot hold, values from 1e12 on, NaN
    and infinity, is rounded as a double.
    """
    exact = F.round(value.try_cast(DecimalType(18, 6)), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    """All fractional columns rounded to ``digits``; the others as they are."""
    return df.select(
        *[
            round_to(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, FractionalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def floor_multiple(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)) * F.lit(width)


def ceil_multiple(value: Column, width: float) -> Column:
    return F.ceil(value / F.lit(width)) * F.lit(width)
