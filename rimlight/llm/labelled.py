"""Labelled rows for a classifier: a bounded sample, chosen by a hash of the id, with whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import crc_fold, cut_lineage, joined

FOLDS = 5
_SLICES = 1 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = FOLDS) -> DataFrame:
    """(text, y) of about ``max_rows`` labelled documents outside fold 0, in one partition.

    The share of labelled ids that is taken follows from their count; which ones, from a hash of the
    id. An id labelled more than once takes the greater label; null ids and labels are left out; of a
    repeated doc_id the least text is taken.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .where(crc_fold(folds) != 0)
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES))
    total = known.count()
    share = _SLICES if total <= max_rows else _SLICES * max_rows // total
    chosen = cut_lineage(known.where(place < share))
    few = joined(docs.select("doc_id", F.col("text").cast("string")), F.broadcast(chosen), "doc_id")
    few = few.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return few.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id").select("text", "y")
