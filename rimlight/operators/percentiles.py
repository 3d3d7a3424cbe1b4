"""Exact percentiles with linear interpolation, and the band of each value between them."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.session import cut_lineage

STEPS = 100
# Distinct values one task ranks; above it the value range is cut into buckets.
MAX_BUCKET_VALUES = 1_000_000
MAX_BUCKETS = 10_000


def _buckets(counts: DataFrame, max_values: int) -> DataFrame:
    """``counts`` with a bucket that grows with the value, of about equal numbers of rows."""
    distinct = counts.count()
    parts = min(max(math.ceil(distinct / max_values), 2), MAX_BUCKETS)
    places = [k / parts for k in range(1, parts)]
    cuts = set(counts.approxQuantile("value", places, 0.25 / parts)) if distinct else {0.0}
    splits = [-math.inf, *sorted(cuts - {-math.inf, math.inf}), math.inf]
    if len(splits) == 2:
        return counts.withColumn("bucket", F.when(F.col("value").isNotNull(), 0.0))
    return Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(counts)


def _offsets(buckets: DataFrame) -> DataFrame:
    """Per bucket the count of the values in the buckets below, and of all values.

    At most MAX_BUCKETS rows: few enough for one task and for a broadcast.
    """
    ordered = Window.orderBy("bucket")
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = buckets.groupBy("bucket").agg(F.sum("n_value").alias("n_bucket"))
    return sums.select(
        "bucket",
        F.coalesce(F.sum("n_bucket").over(below), F.lit(0)).alias("offset"),
        F.sum("n_bucket").over(everything).alias("n"),
    )


def _position(step: Column, n: Column, steps: int) -> Column:
    """One-based fractional rank of a percentile."""
    return F.lit(1.0) + (n - 1).cast("double") * (step.cast("double") * F.lit(1.0 / steps))


def percentile_breaks(
    df: DataFrame, column: str, steps: int = STEPS, max_bucket_values: int = MAX_BUCKET_VALUES
) -> DataFrame:
    """``percent`` (0 ... ``steps``) and ``breakpoint``: exact, interpolated, nulls left out.

    Equal values are first counted, so a value that fills the column is one row.
    """
    value = F.col(column).cast("double")
    counts = (
        df.select(value.alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n_value"))
    )
    return breaks_of_counts(counts, steps, max_bucket_values)


def breaks_of_counts(
    counts: DataFrame, steps: int = STEPS, max_bucket_values: int = MAX_BUCKET_VALUES
) -> DataFrame:
    """The breakpoints from distinct values with their numbers of rows (value, n_value).

    The values are cut into buckets by approximate quantiles, which only balance the work: ranks are
    exact running counts within a bucket plus the counts of the buckets below.
    """
    counts = cut_lineage(counts)
    buckets = _buckets(counts, max_bucket_values)
    running = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        buckets.withColumn("upto", F.sum("n_value").over(running))
        .join(F.broadcast(_offsets(buckets)), "bucket")
        .select("value", "n", (F.col("offset") + F.col("upto")).alias("last"), "n_value")
        .withColumn("first", F.col("last") - F.col("n_value") + 1)
    )
    # A value holds the ranks first ... last; look only at the percentiles near them.
    per_step = F.greatest(F.col("n") - 1, F.lit(1)) / F.lit(float(steps))
    nearby = F.sequence(
        F.greatest(F.floor((F.col("first") - 2) / per_step) - 1, F.lit(0)),
        F.least(F.ceil(F.col("last") / per_step) + 1, F.lit(steps)),
    )
    held = F.col("rank").between(F.col("first"), F.col("last"))
    at = _position(F.col("step"), F.col("n"), steps)
    hits = (
        ranked.withColumn("step", F.explode(nearby))
        .select(
            F.col("step").cast("int").alias("percent"),
            "value",
            "first",
            "last",
            at.alias("at"),
        )
        .withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
        .where(held)
    )
    low = F.max(F.when(F.col("rank") == F.floor("at"), F.col("value")))
    high = F.max(F.when(F.col("rank") == F.ceil("at"), F.col("value")))
    weight = F.col("at") - F.floor("at")
    return (
        hits.groupBy("percent", "at")
        .agg(low.alias("low"), high.alias("high"))
        .select(
            "percent",
            F.when(F.col("low") == F.col("high"), F.col("low"))
            .otherwise((1 - weight) * F.col("low") + weight * F.col("high"))
            .alias("breakpoint"),
        )
    )


def percentile_bands(
    df: DataFrame, column: str, band: str = "band", steps: int = STEPS, **kwargs: int
) -> DataFrame:
    """``df`` with the number of breakpoints below each value, 0 for the minimum; null for null.

    The breakpoints come in as a one-row subquery of ``steps`` + 1 numbers. ``df`` is read twice.
    """
    breaks = percentile_breaks(df, column, steps, **kwargs)
    array = breaks.agg(F.sort_array(F.collect_list("breakpoint")).alias("breaks")).scalar()
    below = F.size(F.filter("_breaks", lambda b: b < F.col(column)))
    return (
        df.withColumn("_breaks", array)
        .withColumn(band, F.when(F.col(column).isNotNull(), below).cast("bigint"))
        .drop("_breaks")
    )
