"""Helpers shared by the operators: shared-folder tables, Arrow batches, counted broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import rimlight
from rimlight.session import cut_lineage, scratch_path

# ASCII white space, as the contracts list it.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Rows and bytes that a Python worker gets at once; texts are processed in pieces of a megabyte.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
# Rows of two or three numbers: some 30 MB in a task.
MAX_BROADCAST_ROWS = 500_000

_shipped: set[str] = set()

__all__ = ["BATCH_ROWS", "MAX_BROADCAST_ROWS", "SPACES", "WORD", "bounded_side", "crc_fold", "cut_lineage",
           "joined", "scratch_path", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(rimlight.__file__).parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="rimlight-")) / f"rimlight-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: long texts must fit a Python worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_fold(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the key's text modulo ``folds``; a null key is fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def bounded_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, marked for a broadcast if its count is within ``max_rows``."""
    return F.broadcast(df) if df.count() <= max_rows else df


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi join on one column in which null keys match."""
    other = right.withColumnRenamed(key, "_key")
    out = left.join(other, left[key].eqNullSafe(other["_key"]), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_key")
