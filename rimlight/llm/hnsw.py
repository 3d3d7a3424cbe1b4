"""Approximate nearest neighbours: a hierarchical small-world graph per shard, results merged.

A shard holds its vectors as one matrix and the graph as one flat neighbour array per layer. Points
enter in doubling batches; insertion and search run for many queries at once in numpy, each with its
own beam. Vectors are extended by one component that makes all lengths equal, so that the largest
inner product is the nearest point; scores are computed on the vectors as given, in double precision.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import cut_lineage, small_batches

M, EF_BUILD, EF_SEARCH = 16, 64, 160
MIN_SHARDS, SHARD_ROWS = 6, 200_000
QUERY_BLOCK, BLOCK_ROWS = 128, 65_536


class Graph:
    """Layers of flat neighbour arrays over the rows of one matrix; -1 marks no neighbour."""

    def __init__(self, x: np.ndarray, order: np.ndarray, layers: list[np.ndarray]):
        self.x, self.order, self.layers = x, order, layers
        self.counts = [len(links) for links in layers]

    @classmethod
    def build(cls, points: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 11) -> Graph:
        longest = np.sqrt((points**2).sum(axis=1).max(initial=0))
        rest = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
        # the layer of a point is geometric with ratio 1 / m; points enter highest first, so that
        # those of a layer are a prefix of the entry order
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(points))) / np.log(m)).astype(int)
        order = np.argsort(-levels, kind="stable")
        counts = [int((levels >= k).sum()) for k in range(levels.max(initial=0) + 1)]
        layers = [np.full((count, m if k else 2 * m), -1, np.int32) for k, count in enumerate(counts)]
        graph = cls(np.hstack([points, rest[:, None]]).astype(np.float32)[order], order, layers)
        for k in range(len(counts) - 1, -1, -1):
            graph._build(k, ef)
        return graph

    def _build(self, k: int, ef: int) -> None:
        count, links = self.counts[k], self.layers[k]
        width = links.shape[1]
        done = min(count, width + 1)
        for i in range(done):
            others = np.delete(np.arange(done), i)[:width]
            links[i, : len(others)] = others
        while done < count:
            more = min(count, done + max(32, done // 4))
            for low in range(done, more, QUERY_BLOCK):
                rows = np.arange(low, min(low + QUERY_BLOCK, more))
                near, score = self._beam(self.x[rows], k, self._descend(self.x[rows], k, done), ef, done)
                self._link(k, rows, near, score)
            done = more

    def _diverse(self, near: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
        """Of candidates in falling score: those closer to the point than to any taken; then fill up."""
        rows, width = near.shape
        valid = near >= 0
        vectors = self.x[np.maximum(near, 0)]
        taken = np.zeros((rows, width), bool)
        worst = np.full((rows, width), -np.inf, np.float32)
        number = np.zeros(rows, int)
        for j in range(width):
            good = valid[:, j] & (score[:, j] > worst[:, j]) & (number < keep)
            taken[:, j] = good
            number += good
            if good.any():
                close = np.einsum("rwd,rd->rw", vectors[good], vectors[good, j])
                worst[good] = np.maximum(worst[good], close)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(near, best, axis=1)

    def _link(self, k: int, rows: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        links = self.layers[k]
        width = links.shape[1]
        chosen = self._diverse(near, score, width // 2 if k == 0 else width)
        links[rows, : chosen.shape[1]] = chosen
        # links back: each target takes its new sources, and keeps the best spread of all
        source = np.repeat(rows, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads, begin, number = np.unique(target, return_index=True, return_counts=True)
        slots = np.full((len(heads), width + number.max(initial=0)), -1, np.int64)
        slots[:, :width] = links[heads]
        place = np.arange(len(target)) - np.repeat(begin, number)
        slots[np.repeat(np.arange(len(heads)), number), width + place] = source
        free = (slots >= 0).sum(axis=1)
        easy = free <= width
        packed = np.argsort(slots < 0, axis=1, kind="stable")
        links[heads[easy]] = np.take_along_axis(slots, packed, axis=1)[easy, :width]
        for low in range(0, int((~easy).sum()), QUERY_BLOCK):
            part = np.flatnonzero(~easy)[low : low + QUERY_BLOCK]
            cand = slots[part]
            s = np.einsum("rwd,rd->rw", self.x[np.maximum(cand, 0)], self.x[heads[part]])
            s[cand < 0] = -np.inf
            o = np.argsort(-s, axis=1, kind="stable")
            cand, s = np.take_along_axis(cand, o, axis=1), np.take_along_axis(s, o, axis=1)
            links[heads[part]] = self._diverse(cand, s, width)

    def _descend(self, q: np.ndarray, k: int, done: int) -> np.ndarray:
        entry = np.zeros(len(q), np.int64)
        for layer in range(len(self.layers) - 1, k, -1):
            near, _ = self._beam(q, layer, entry, 1, self.counts[layer])
            entry = near[:, 0]
        return np.minimum(entry, done - 1)

    def _beam(self, q: np.ndarray, k: int, entry: np.ndarray, ef: int, done: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best points found for each query, best first, and their products."""
        links, n = self.layers[k], len(q)
        rows = np.arange(n)
        seen = np.zeros((n, done), bool)
        seen[rows, entry] = True
        near = np.full((n, ef), -1, np.int64)
        score = np.full((n, ef), -np.inf, np.float32)
        fresh = np.zeros((n, ef), bool)
        near[:, 0], score[:, 0], fresh[:, 0] = entry, np.einsum("nd,nd->n", q, self.x[entry]), True
        live = rows
        while len(live):
            at = np.argmax(np.where(fresh[live], score[live], -np.inf), axis=1)
            open_ = fresh[live, at]
            live, at = live[open_], at[open_]
            if not len(live):
                break
            fresh[live, at] = False
            step = links[near[live, at]].astype(np.int64)
            ok = (step >= 0) & (step < done)
            safe = np.where(ok, step, 0)
            ok &= ~seen[live[:, None], safe]
            seen[live[:, None], safe] |= ok
            s = np.einsum("rwd,rd->rw", self.x[safe], q[live])
            s[~ok] = -np.inf
            all_near = np.concatenate([near[live], safe], axis=1)
            all_score = np.concatenate([score[live], s], axis=1)
            all_fresh = np.concatenate([fresh[live], ok], axis=1)
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            near[live] = np.take_along_axis(all_near, top, axis=1)
            score[live] = np.take_along_axis(all_score, top, axis=1)
            fresh[live] = np.take_along_axis(all_fresh, top, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
        return np.where(np.isfinite(score), near, -1), score

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """(queries, ef) rows of the matrix as given, -1 where fewer were found."""
        q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        found = []
        for low in range(0, len(q), QUERY_BLOCK):
            part = q[low : low + QUERY_BLOCK]
            near, _ = self._beam(part, 0, self._descend(part, 0, len(self.x)), ef, len(self.x))
            found.append(np.where(near >= 0, self.order[np.maximum(near, 0)], -1))
        return np.concatenate(found) if found else np.zeros((0, ef), int)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part: finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    taken = F.col("vec_id").isNotNull() & v.isNotNull() & finite & ~zero
    return vectors.where(taken).select(F.col("vec_id").cast("long"), v.alias("v"))


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def indexed(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """(shard, dim, index) with each shard's graph over its distinct vectors, as flat arrays.

    Of equal vectors at most k rows of an id stay, and the 2 k of least ids among those: a query leaves out the rows
    of one id, at most k of them, and takes no more than k of the others.
    """

    def build(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("vec_id", kind="stable")
        x, place = np.unique(np.stack(points.v.to_numpy()), axis=0, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        place, ids = place.ravel()[order], points.vec_id.to_numpy()[order]
        start = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (ids[1:] != ids[:-1])])
        copy = np.arange(len(place)) - np.repeat(start, np.diff(np.r_[start, len(place)]))
        place, ids = place[copy < k], ids[copy < k]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        few = nth < 2 * k
        members, real = (np.zeros((len(x), nth[few].max() + 1), t) for t in (np.int64, bool))
        members[place[few], nth[few]] = ids[few]
        real[place[few], nth[few]] = True
        graph = Graph.build(x)
        layers = {f"layer{i}": links for i, links in enumerate(graph.layers)}
        index = packed({"points": x, "members": members, "real": real, "x": graph.x, "order": graph.order, **layers})
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "index": [index]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int"))
    # one task for each shard: the work is in the graphs, not in the bytes that adaptive plans go by
    dealt = dealt.repartitionById(shards, "shard")
    return dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, index binary")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, ef: int = EF_SEARCH,
    min_shards: int = MIN_SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id ``every`` divides.

    Vectors that are null or zero, or hold a null or non-finite component, take no part, nor do null
    ids; vectors of another length than a query's are no candidates of it. Of rows repeated with their
    vec_id each is a candidate, and the least vector is the query. A query's own id is no candidate.
    Every row is indexed; a shard holds about ``shard_rows`` of them at most. All queries search all
    shards, in blocks of about ``block_rows``. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows = cut_lineage(usable(vectors).withColumn("dim", F.size("v")))
    shards = max(min_shards, -(-rows.count() // shard_rows))
    asked = cut_lineage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = asked.select(
        "vec_id", "v", F.size("v").alias("dim"), block.alias("block"), F.explode(_numbers(shards)).alias("shard")
    )
    graphs = cut_lineage(indexed(rows, shards, k)).withColumn("block", F.explode(_numbers(blocks)))

    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": []})]
        if len(index) and len(queries):
            data = dict(np.load(io.BytesIO(index["index"].iloc[0])))
            graph = Graph(data["x"], data["order"], [data[f"layer{i}"] for i in range(len(data) - 5)])
            for low in range(0, len(queries), QUERY_BLOCK):
                asker = queries.vec_id.to_numpy()[low : low + QUERY_BLOCK]
                q = np.stack(queries.v.to_numpy()[low : low + QUERY_BLOCK])
                near = graph.search(q, ef)
                exact = np.einsum("qwd,qd->qw", data["points"][np.maximum(near, 0)], q)
                exact[near < 0] = -np.inf
                ids = data["members"][np.maximum(near, 0)]
                score = np.where(data["real"][np.maximum(near, 0)], exact[:, :, None], -np.inf)
                score[ids == asker[:, None, None]] = -np.inf
                ids, score = ids.reshape(len(q), -1), score.reshape(len(q), -1)
                best = np.lexsort((ids, -score), axis=1)[:, :k]
                ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
                good = np.isfinite(score)
                parts.append(
                    pd.DataFrame(
                        {"query_id": np.repeat(asker, good.sum(axis=1)), "vec_id": ids[good], "score": score[good]}
                    )
                )
        return pd.concat(parts)

    keys = ["shard", "dim", "block"]
    found = (
        graphs.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbers(n: int):
    return F.sequence(F.lit(0), F.lit(n - 1))
