"""Training-order materialisation: every sequence gets a global slot and is written there.

The texts of each input partition are one stream of token ids, one end id after each text, cut into
sequences of equal length. A keyed Feistel network over the least even number of bits that holds all
sequences is walked until it lands below their number, which makes a permutation of 0 .. n - 1: the
training order. Partition i of the shuffle holds exactly the slots of shard i, sorted, and writes one file of
fixed stride, so that slot s is at byte (s mod per_shard) * stride of shard s // per_shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.llm.common import scratch_path, small_batches
from rimlight.llm.text import U64, mix, text_buffers

# Byte-level ids: a byte of UTF-8 text is its own id; these two bytes are never in UTF-8.
PAD, END = 254, 255
LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 16_384, 20240607, 6


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each x of 0 .. n - 1 in the permutation that ``key`` names."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) + U64(key % (1 << 63)))
    out = x.astype(U64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> U64(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[walking] = left << U64(half) | right
        walking = walking[out[walking] >= U64(n)]
    return out.astype(np.int64)


class _Stream:
    """Cuts the texts of one partition into sequences, with the ids of the documents in each."""

    def __init__(self, length: int):
        self.length = length
        self.rest, self.starts, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int64), []

    def add(self, data: np.ndarray, offsets: np.ndarray, ids: list) -> tuple[np.ndarray, list[list]]:
        n = len(offsets) - 1
        stream = np.full(len(data) + n, END, np.uint8)
        stream[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        self.starts = np.concatenate([self.starts, offsets[:-1] + np.arange(n) + len(self.rest)])
        self.ids = self.ids + ids
        self.rest = np.concatenate([self.rest, stream])
        return self._take(len(self.rest) // self.length)

    def _take(self, whole: int) -> tuple[np.ndarray, list[list]]:
        size = self.length
        out = self.rest[: whole * size].reshape(whole, size)
        edges = np.arange(whole + 1) * size
        first = np.maximum(np.searchsorted(self.starts, edges, "right") - 1, 0)
        after = np.searchsorted(self.starts, edges, "left")
        inside = [self.ids[first[k] : after[k + 1]] for k in range(whole)]
        self.rest = self.rest[whole * size :]
        kept = first[-1] if len(self.rest) else len(self.ids)
        self.starts, self.ids = np.maximum(self.starts[kept:] - whole * size, 0), self.ids[kept:]
        return out, inside

    def last(self) -> tuple[np.ndarray, list[list], int]:
        used = len(self.rest)
        if not used:
            return np.zeros((0, self.length), np.uint8), [], 0
        self.rest = np.concatenate([self.rest, np.full(self.length - used, PAD, np.uint8)])
        out, inside = self._take(1)
        return out, inside, used


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"))


def partition_sizes(docs: DataFrame) -> np.ndarray:
    """Tokens of each input partition; a number for each comes to the driver."""
    size = F.sum(F.octet_length("text") + F.lit(1))
    measured = _rows(docs).groupBy(F.spark_partition_id().alias("p")).agg(size.alias("n")).toPandas()
    number = np.zeros(int(measured.p.max()) + 1 if len(measured) else 0, np.int64)
    number[measured.p.to_numpy(int)] = measured.n.to_numpy(int)
    return number


def sequences(docs: DataFrame, number: np.ndarray, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """slot, n_tokens, doc_ids, tokens (``length`` bytes) for all whole texts of ``docs``.

    ``number`` is ``partition_sizes(docs)``, which gives each partition its range of numbers; a task
    that meets another partition than was measured fails. ``docs`` must be a table as read, whose
    partitions come out alike each time. Null texts are empty and give their end id alone.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs)
    count = -(-number // length)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    # a few bytes for each partition of the input
    shared = docs.sparkSession.sparkContext.broadcast((number, first))
    schema = "slot long, n_tokens int, doc_ids array<long>, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, first = shared.value
        at = int(first[part]) if part < len(number) else 0
        stream, met = _Stream(length), 0

        def batch_of(out: np.ndarray, inside: list[list], used: int) -> pa.RecordBatch:
            slots = feistel(at + np.arange(len(out)), total, key)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(slots),
                    pa.array(np.full(len(out), used, np.int32)),
                    pa.array(inside, pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in out], pa.binary()),
                ],
                ["slot", "n_tokens", "doc_ids", "tokens"],
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, data, offsets in text_buffers(batch.column(1)):
                met += len(data) + len(offsets) - 1
                out, inside = stream.add(data, offsets, ids[low : low + len(offsets) - 1])
                yield batch_of(out, inside, length)
                at += len(out)
        out, inside, used = stream.last()
        yield batch_of(out, inside, used)
        if met != (number[part] if part < len(number) else 0):
            raise RuntimeError("the partitions of the input changed between two passes")

    return rows.mapInArrow(cut, schema)


def materialise(
    docs: DataFrame, out_dir: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY
) -> DataFrame:
    """Write all sequences of ``docs`` below ``out_dir``; one row per slot with what was written.

    slot, shard, position, n_tokens, doc_ids, tokens_crc32. ``out_dir`` is a folder that all executors
    share, named by a URI that pyarrow opens. A task writes its shard under a name of its own and renames it
    when done, so a task that runs again leaves the same file. Repeated rows are written each; an empty
    table gives no rows and no shard. manifest.json has the lengths, for ``read_slots``.
    """
    spark = docs.sparkSession
    sizes = partition_sizes(docs)
    total = int((-(-sizes // length)).sum())
    cut = sequences(docs, sizes, length, key)
    shards = max(1, -(-total // per_shard))
    schema = "slot long, shard int, position int, n_tokens int, doc_ids array<long>, tokens_crc32 long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        shard = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(out_dir)
        part, file, at = f"{folder}/.{uuid.uuid4().hex}", None, shard * per_shard
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(0).to_numpy()
            if slots[0] != at or (np.diff(slots) != 1).any() or slots[-1] >= (shard + 1) * per_shard:
                raise RuntimeError("slots of a shard are not complete")
            if file is None:
                store.create_dir(folder, recursive=True)
                file = store.open_output_stream(part)
            tokens = batch.column(3).to_pylist()
            file.write(b"".join(tokens))
            at += len(slots)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(slots), shard, np.int32)),
                    pa.array((slots - shard * per_shard).astype(np.int32)),
                    batch.column(1),
                    batch.column(2),
                    pa.array([zlib.crc32(t) for t in tokens], pa.int64()),
                ],
                ["slot", "shard", "position", "n_tokens", "doc_ids", "tokens_crc32"],
            )
        if file is not None:
            file.close()
            store.move(part, f"{folder}/{shard_name(shard)}")

    manifest = {"sequences": total, "length": length, "per_shard": per_shard, "shards": shards if total else 0, "key": key}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{out_dir}/manifest"
    )
    dealt = cut.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int"))
    return dealt.sortWithinPartitions("slot").mapInArrow(write, schema)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def read_slots(spark: SparkSession, out_dir: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, tokens of the slots from ``start`` to before ``stop``, by seeking in the shards."""
    small_batches(spark)
    facts = json.loads(spark.read.text(f"{out_dir}/manifest").first()[0])
    stop = min(facts["sequences"] if stop is None else stop, facts["sequences"])
    start = max(0, min(start, stop))
    stride, per_shard = facts["length"], facts["per_shard"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for run in np.split(slots, np.flatnonzero(np.diff(slots // per_shard)) + 1):
                if not len(run):
                    continue
                with store.open_input_file(f"{folder}/{shard_name(int(run[0]) // per_shard)}") as file:
                    file.seek(int(run[0]) % per_shard * stride)
                    data = file.read(len(run) * stride)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run), pa.array([data[i * stride : (i + 1) * stride] for i in range(len(run))], pa.binary())],
                    ["slot", "tokens"],
                )

    pieces = max(1, -(-(stop - start) // per_shard))
    return spark.range(start, stop, 1, pieces).mapInArrow(read, "slot long, tokens binary")


def materialised_documents(docs: DataFrame, **options) -> DataFrame:
    """``materialise`` into a new folder of the shared one."""
    return materialise(docs, scratch_path(docs.sparkSession, "sequences"), **options)
