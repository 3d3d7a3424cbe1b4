"""Exact duplicates with skew-safe combining, in DataFrame functions only.

Rows are combined in three stages, each by the full normalised content beside its digest: Spark's
map-side aggregation removes duplicates within a task, a merge by (digest, salt) takes what the
tasks left, and the winners of the salts are combined per digest. So a text with a third of all rows
sends one row per task to each of ``salts`` places, and at most ``salts`` rows to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import SPACES, cut_lineage

SALTS = 16


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES + "+", "")


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def exact_groups(
    docs: DataFrame,
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space. The row with the most code points in the
    original text stays, then the smallest doc_id, a null doc_id last. Null texts count as empty, and
    empty texts are one group. Rows repeated with their doc_id each return, all kept if that doc_id
    is. Only doc_id and text are read, so further columns may have any name; an empty table gives no rows.
    ``digest`` may collide: contents are compared in full.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        without_spaces(F.col("text")).alias("content"),
        F.char_length("text").alias("points"),
    ).withColumn("digest", digest(F.col("content")))
    # min() of this order is the row that stays
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("rank", rank)
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("rank").alias("rank"), F.count("*").alias("size"))
    # dealt by the digest alone, so that the count of contents per digest needs no further shuffle
    groups = (
        merged.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("rank").alias("rank"), F.sum("size").alias("group_size"))
    )
    lone = cut_lineage(
        groups.groupBy("digest").agg(
            F.count("*").alias("contents"),
            F.min("rank.doc_id").alias("keep_id"),
            F.min("group_size").alias("group_size"),
        )
    )
    ids = rows.select("doc_id", "digest")
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    found = ids.join(lone.where("contents = 1"), "digest").select(columns)
    clashes = lone.where("contents > 1").select("digest")
    if not clashes.isEmpty():  # only a weak digest gets here: its few contents are compared again
        apart = groups.join(clashes, "digest", "left_semi").withColumn("keep_id", F.col("rank.doc_id"))
        found = found.unionByName(rows.join(apart, ["digest", "content"]).select(columns))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
