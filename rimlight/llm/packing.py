"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by a hash of their id into shards of bounded total length; a shard is packed
longest first. Its bins stand in classes by residual room, and carry the set of sources and of
duplicate clusters they hold as bitmaps (Python integers over the shard's own numbering). The
successor search starts at the least room that fits and goes on until a bin without a conflict is
found; a new bin is opened if there is none. So no bin holds two documents of a duplicate cluster, or more
than ``per_source`` of a source.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import SPACES, WORD, cut_lineage, small_batches

CAPACITY = 2048
PER_SOURCE = 4
SHARD_PIECES = 4096
SCHEMA = (
    "doc_id long, piece long, n_pieces long, n_tokens long, source string, cluster long, "
    "shard long, bin long, start long, room long"
)


class _Bins:
    """Open bins in classes of equal room; a class keeps bins of equal source bitmap together."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.classes: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        self.rooms = 0  # bit r is set if a bin has room r
        self.clusters: list[int] = []
        self.room: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) for one item."""
        mine = 1 << cluster
        # layer k of the source bitmaps tells which sources are in the bin more than k times
        rooms = self.rooms >> size
        room = size
        while rooms:
            step = (rooms & -rooms).bit_length() - 1
            room += step
            rooms >>= step
            for layers, bins in self.classes[room].items():
                if layers[-1] >> source & 1:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not self.clusters[bins[k]] & mine:
                        found = bins[k]
                        bins[k] = bins[-1]
                        bins.pop()
                        return self._move(found, room, layers, size, source, mine)
            rooms >>= 1
            room += 1
        self.clusters.append(0)
        self.room.append(self.capacity)
        return self._move(len(self.room) - 1, self.capacity, (0,) * self.per_source, size, source, mine, new=True)

    def _move(self, found, room, layers, size, source, mine, new=False) -> tuple[int, int]:
        if not new and not self.classes[room][layers]:
            del self.classes[room][layers]
            if not self.classes[room]:
                self.rooms &= ~(1 << room)
        left = list(layers)
        for k, bits in enumerate(left):
            if not bits >> source & 1:
                left[k] = bits | 1 << source
                break
        self.clusters[found] |= mine
        self.room[found] = room - size
        if room > size:
            self.classes[room - size].setdefault(tuple(left), []).append(found)
            self.rooms |= 1 << (room - size)
        return found, self.capacity - room


def pack_shard(sizes: np.ndarray, sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list, list, list]:
    """(bin, start, room left in the bin) of each item, in the order given; sizes are 1 .. capacity."""
    numbers: tuple[dict, dict] = ({}, {})
    bins = _Bins(capacity, per_source)
    placed = [
        bins.put(int(s), numbers[0].setdefault(a, len(numbers[0])), numbers[1].setdefault(c, len(numbers[1])))
        for s, a, c in zip(sizes, sources, clusters, strict=True)
    ]
    return [b for b, _ in placed], [s for _, s in placed], [bins.room[b] for b, _ in placed]


def with_items(docs: DataFrame) -> DataFrame:
    """doc_id, source, cluster (hash of the text without white space), n_tokens (words and one end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.xxhash64(F.regexp_replace(text, SPACES + "+", "")).alias("cluster"),
        (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("n_tokens"),
    )


def numbered(items: DataFrame, run: int = 10_000) -> DataFrame:
    """``items`` with the number of each row among its equals, ``copy``, from 0; the order of rows is lost.

    Equal rows are counted before the shuffle and written out again in runs of ``run``, which tasks share.
    """
    names = items.columns
    counts = items.groupBy(*names).agg(F.count("*").alias("copies"))
    runs = counts.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(run))).alias("first"))
    end = F.least(F.col("copies"), F.col("first") + run) - 1
    # single rows, nearly all, are dealt already
    few, many = runs.where(F.col("copies") <= run), runs.where(F.col("copies") > run).repartition(*names, "first")
    return few.unionByName(many).select(*names, F.explode(F.sequence(F.col("first"), end)).alias("copy"))


def best_fit(
    items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """One row per piece of a document: where it stands in which bin of which shard.

    ``items`` has doc_id, source, cluster, n_tokens. A document longer than ``capacity`` is cut into
    full pieces and a rest; a full piece fills a bin alone. A null source is a source of its own, a
    null cluster conflicts with nothing; of null or negative length is taken as 0, and such a document takes
    one token's room. Repeated rows return each, numbered from counts and dealt over all shards by their number. ``room`` is what its bin has left. An empty table
    gives no rows. Shards take about ``shard_pieces`` rests, and full pieces are numbered beside them.
    """
    small_batches(items.sparkSession)
    size = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(1))
    items = items.select("doc_id", "source", "cluster", size.alias("n_tokens"))
    shards = max(1, -(-items.count() // shard_pieces))
    items = numbered(items)
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("long")
    dealt = items.withColumns(
        {"shard": F.pmod(F.xxhash64("doc_id", "n_tokens", "cluster", "copy"), F.lit(shards)), "full": full}
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rest = rows.n_tokens - rows.full * capacity
        rows = rows.assign(rest=rest).sort_values(
            ["rest", "doc_id", "n_tokens", "cluster", "source", "copy"], ascending=[False, *[True] * 5], kind="stable"
        )
        clusters = [("n", i) if pd.isna(c) else c for i, c in enumerate(rows.cluster.tolist())]
        sources = [None if s is None or s != s else s for s in rows.source.tolist()]
        bins, starts, rooms = pack_shard(rows.rest.to_numpy(), sources, clusters, capacity, per_source)
        rows = rows.assign(bin=bins, start=starts, room=rooms, piece=rows.full, n_pieces=rows.full + 1)
        long = rows[rows.full > 0]
        parts = [rows.assign(n_tokens=rows.rest)]
        if len(long):
            more = long.loc[long.index.repeat(long.full.astype(int))]
            piece = more.groupby(level=0).cumcount()
            first = (max(bins) + 1) if bins else 0
            parts.append(
                more.assign(piece=piece, n_tokens=capacity, start=0, room=0, bin=first + np.arange(len(more)))
            )
        out = pd.concat(parts, ignore_index=True)
        return out[[c.split()[0] for c in SCHEMA.split(", ")]]

    return dealt.groupBy("shard").applyInPandas(pack, SCHEMA)


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    """``best_fit`` of whole documents; items are written first, so that texts are read once."""
    return best_fit(cut_lineage(with_items(docs)), **options)
