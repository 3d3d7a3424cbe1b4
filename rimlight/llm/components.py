"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the greater (large) or the smaller neighbours of each node on its least neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
    near = links.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
    hung = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("_m").alias("v"))
    return hung.where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node connected with it.

    Nodes are not null; a link from a node to itself adds nothing. No links give no rows.
    Each round is written to the shared folder; links shrink to stars in about log(nodes) rounds.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, before = cut_lineage(now.distinct()), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut_lineage(_star(_star(both, large=True), large=False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
