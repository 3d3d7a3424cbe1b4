"""Session settings and shared-folder lookup."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PLACES_KEY = "spark.sql.sources.ignoreDataLocality"
STATUSES_KEY = "spark.sql.hive.filesourcePartitionFileCacheSize"
LISTING_KEY, LISTING_WAVES = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4

# Settings the jobs are written for. AQE splits skewed join partitions, also where the split costs
# one more shuffle, and turns a join into a broadcast once the measured side is under the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "rimlight", **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` entries (dots as double underscores) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    extra = {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only a local session may go without it: a machine-local folder is of no use to executors on
    other hosts, so a cluster session without the setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = "file://" + tempfile.mkdtemp(prefix="rimlight-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of its own under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    made = _scratch.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to scratch paths inside; for work whose results are stored elsewhere."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            delete_path(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of ``spark`` inside; a stream started there keeps it."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted as it ends; for writes, as a frame that runs again makes them again.

    Else they stay until the driver collects its garbage.
    """
    with setting(spark, SHUFFLES_KEY, "true"):
        yield


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, a scan lists its folders and files by LISTING_WAVES tasks a core.

    Spark's own bound is a task for each folder up to 10,000, whose dealing out takes longer than the listing.
    """
    tasks = min(int(spark.conf.get(LISTING_KEY)), LISTING_WAVES * spark.sparkContext.defaultParallelism)
    with setting(spark, LISTING_KEY, tasks):
        yield


def listing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` but few listing tasks, for streams, which list by their reader's session.

    It caches no file statuses, as a stream reads a file once and the cache would hold those of all its batches, and lists
    files without their blocks' places, which the driver would hold for each.
    """
    with few_listing_tasks(spark):
        settings = {**dict(spark.conf.getAll), STATUSES_KEY: "0", PLACES_KEY: "true"}
    other = spark.newSession()
    for key, value in settings.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` of another session as a frame of ``spark``."""
    name = f"frame_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    For a frame that several branches read: they see the same rows even if an executor is lost
    between them, and the reader gets file statistics, column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
