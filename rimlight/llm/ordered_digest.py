"""SHA-256 of long ordered concatenations, by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digests(rows: DataFrame, order: list[str], separator: str) -> DataFrame:
    """(key, sha256) of (key, *order, value): the key's values in order, joined by ``separator``.

    The rows are sorted over all tasks and joined to blocks there, whatever a key's size; what remains for one
    task is to run over a key's blocks, which the digest demands, with one block in memory at a time.
    """
    gap = separator.encode()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, numbers, parts = [], [], []
            held: list[str] = []
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, name in enumerate(names):
                held.append(values[k])
                if k + 1 == len(names) or names[k + 1] != name:
                    keys.append(name)
                    numbers.append(place)
                    parts.append(separator.join(held).encode())
                    place += 1
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers), pa.array(parts, pa.binary())], ["key", "block", "part"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest, found = False, hashlib.sha256(), []

        def done() -> pa.RecordBatch:
            names, values = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values)], ["key", "sha256"])

        now = None
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if open_ and key == now:
                    digest.update(gap)
                else:
                    if open_:
                        found.append((now, digest.hexdigest()))
                    open_, now, digest = True, key, hashlib.sha256()
                digest.update(part)
            if len(found) > 10_000:
                yield done()
                found = []
        if open_:
            found.append((now, digest.hexdigest()))
            yield done()

    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).select("key", F.col("value").cast("string"))
    joined = dealt.mapInArrow(blocks, "key string, block long, part binary")
    return joined.repartition("key").sortWithinPartitions("key", "block").mapInArrow(digests, "key string, sha256 string")
