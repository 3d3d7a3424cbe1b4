"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

Documents with equal shingle sets are one node. Nodes that share a band of their signatures are
candidates. A pair's signatures are compared batch by batch: under a uniform prior the similarity
given m matches of n is Beta(m + 1, n - m + 1), and a pair goes once the probability that it reaches
the threshold is below ``miss``. What survives is confirmed on the full shingle sets.

Instead of all pairs of a bucket, each member is first compared with the bucket's centre. Where
the links found leave a bucket in several components, its members are compared across components by
an exact prefix filter: two sets that are similar enough share one of their rarest shingles, so a
common shingle of a large group makes no pairs within that group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import bounded_side, cut_lineage, joined, small_batches
from rimlight.llm.components import components
from rimlight.llm.text import U64, mix, scan_words, shingle_hashes, text_buffers

BANDS, ROWS = 25, 5
BATCH = 25
MISS = 1e-9


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _signatures(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) least 32-bit values; texts without shingles must not be given."""
    out = np.empty((len(offsets) - 1, n), np.uint32)
    for k, seed in enumerate(_seeds(n)):
        out[:, k] = np.minimum.reduceat(((hashes ^ (seed >> U64(1))) * seed) >> U64(32), offsets[:-1])
    return out


def signature_table(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, node (hash of the shingle set, null without words), signature."""
    n = bands * rows
    schema = "doc_id long, n_shingles long, node long, signature binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, at in text_buffers(batch.column(1)):
                hashes, offsets = shingle_hashes(scan_words(data, at), size)
                full = np.flatnonzero(np.diff(offsets))
                marks = np.append(offsets[full], len(hashes))
                signed = _signatures(hashes, marks, n) if len(full) else None
                count, node = [0] * (len(at) - 1), [None] * (len(at) - 1)
                packed: list = [None] * (len(at) - 1)
                for k, i in enumerate(full):
                    distinct = np.unique(hashes[marks[k] : marks[k + 1]])
                    count[i] = len(distinct)
                    digest = hashlib.blake2b(distinct.tobytes(), digest_size=8).digest()
                    node[i] = int.from_bytes(digest, "little", signed=True)
                    packed[i] = signed[k].tobytes()
                ids = batch.column(0).slice(low, len(at) - 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(count, pa.int64()), pa.array(node, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_shingles", "node", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, schema)


def node_of(text: Column, size: int = 5) -> Column:
    """The node of a text, as in ``signature_table``; null without words."""

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        sets = _sets(pa.array(texts, pa.string(), from_pandas=True), size)
        digests = (hashlib.blake2b(x.tobytes(), digest_size=8).digest() if len(x) else None for x in sets)
        return pd.Series([d and int.from_bytes(d, "little", signed=True) for d in digests], dtype="Int64")

    return node(text.cast("string"))


def band_keys(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node) for each band of each node's signature."""
    width = 4 * rows
    keys = F.array(
        *[F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)) for b in range(bands)]
    )
    return nodes.select("node", F.explode(keys).alias("key"))


def least_matches(n: int, batch: int, percent: int, miss: float) -> list[int]:
    """For n = batch, 2 batch, ... compared values: the least matches with which a pair goes on."""
    t, bounds = percent / 100, []
    for k in range(batch, n + 1, batch):
        # P(Beta(m + 1, k - m + 1) >= t) = P(Binomial(k + 1, t) <= m)
        low, total = 0, 0.0
        for m in range(k + 1):
            total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= miss:
                low = m
                break
        bounds.append(low)
    return bounds


def bayes_filter(pairs: DataFrame, nodes: DataFrame, percent: int, batch: int, miss: float, n: int) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures rules out."""
    bounds = least_matches(n, batch, percent, miss)
    sides = nodes.select("node", "signature", "n_shingles")
    near = (
        pairs.join(sides.withColumnsRenamed({"node": "a", "signature": "sa", "n_shingles": "na"}), "a")
        .join(sides.withColumnsRenamed({"node": "b", "signature": "sb", "n_shingles": "nb"}), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).reshape(rows.num_rows, n)
                for c in (2, 3)
            )
            left, met = np.arange(rows.num_rows), np.zeros(rows.num_rows, int)
            for k, bound in enumerate(bounds):
                part = slice(k * batch, (k + 1) * batch)
                met[left] += (x[left, part] == y[left, part]).sum(axis=1)
                left = left[met[left] >= bound]
            yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(left)) for c in (0, 1)], ["a", "b"])

    return near.select("a", "b", "sa", "sb").mapInArrow(go, "a long, b long")


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for _, data, at in text_buffers(column):
        hashes, offsets = shingle_hashes(scan_words(data, at), size)
        out += [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in range(len(at) - 1)]
    return out


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full shingle sets."""
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b"
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for i, (x, y) in enumerate(zip(_sets(rows.column(2), size), _sets(rows.column(3), size), strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [rows.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"]
            )

    return both.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingle, n) for each distinct shingle of the texts."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            nodes = rows.column(0).to_numpy()
            for node, distinct in zip(nodes, _sets(rows.column(1), size), strict=True):
                n = len(distinct)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, node)),
                        pa.array(distinct.view(np.int64)),
                        pa.array(np.full(n, n, np.int64)),
                    ],
                    ["node", "shingle", "n"],
                )

    return texts.select("node", "text").mapInArrow(unfold, "node long, shingle long, n long")


def cross_pairs(texts: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles.

    A set of n shingles has n - ceil(t n) + 1 of them in its prefix, rarest first by one order for
    all; two sets of similarity t or more share a shingle of their prefixes. At the first that they share,
    no more than the rest of either set can be common, which must suffice for t. Shingles of a single
    set are in no pair and only take the first places.
    """
    rows = shingle_rows(texts, size)
    spread = rows.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    per_node = Window.partitionBy("node")
    place = F.row_number().over(per_node.orderBy("sets", "shingle"))
    own = F.col("n") - F.count("*").over(per_node)
    # shingles of the set from this one on
    after = F.col("n") - F.col("own") - F.col("place") + 1
    prefix = (
        rows.join(spread, "shingle")
        .withColumns({"place": place, "own": own})
        .where(F.col("own") + F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .select("node", "shingle", "n", after.alias("after"))
    )
    prefix = cut_lineage(prefix.join(roots, "node"))
    # the greatest component of a shingle makes no pairs of its own
    sizes = prefix.groupBy("shingle", "root").count()
    main = sizes.groupBy("shingle").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("k"))
    main = main.where("k > 1").select("shingle", F.col("m.root").alias("main"))
    split = prefix.join(main, "shingle")
    left = split.where("root <> main").drop("main")
    left = left.withColumnsRenamed({"node": "x", "root": "rx", "n": "nx", "after": "ax"})
    right = split.drop("main").withColumnsRenamed({"node": "y", "root": "ry", "n": "ny", "after": "ay"})
    right = right.withColumnRenamed("shingle", "_shingle")
    enough = F.least("ax", "ay") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    met = left.join(right, (F.col("shingle") == F.col("_shingle")) & (F.col("rx") != F.col("ry")) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped_nodes(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    batch: int = BATCH,
    miss: float = MISS,
) -> tuple[DataFrame, DataFrame]:
    """The signature table, and (node, doc_id, root): each node's least doc_id and its component."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = cut_lineage(signature_table(docs, size, bands, rows))
    nodes = (
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("signature").alias("signature"),
        )
    )
    nodes = cut_lineage(nodes)
    keys = band_keys(nodes, bands, rows)
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    buckets = cut_lineage(keys.join(shared, "key"))
    links = cut_lineage(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    member = buckets.select("node").distinct()
    if not member.isEmpty():
        member = cut_lineage(member.join(nodes.select("node", "doc_id"), "node"))
        texts = cut_lineage(_texts_of(docs, member, size))
        # a bucket's centre is the member that meets most others, as the original of copies does
        weights = buckets.groupBy("node").agg(F.sum("k").alias("weight"))
        order = F.struct("weight", "node")
        centres = buckets.join(weights, "node").groupBy("key").agg(F.max(order)["node"].alias("centre"))
        pair = F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")
        stars = buckets.join(centres, "key").where("node <> centre").select(*pair).distinct()
        links = _verified(stars, nodes, texts, size, percent, batch, miss, bands * rows)
        roots = components(links)
        root_of = buckets.select("node", "key").join(roots, "node", "left")
        root_of = root_of.withColumn("root", F.coalesce("root", "node"))
        split = root_of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        left = root_of.join(split.select("key"), "key", "left_semi").select("node", "root").distinct()
        left = cut_lineage(left)
        if not left.isEmpty():
            rest = cut_lineage(
                cross_pairs(texts.join(left.select("node"), "node", "left_semi"), left, size, percent)
            )
            more = _verified(rest, nodes, texts, size, percent, batch, miss, bands * rows)
            links = links.unionByName(more)
    roots = components(links)
    named = nodes.select("node", "doc_id").join(roots, "node", "left")
    return signed, named.withColumn("root", F.coalesce("root", "node"))


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    batch: int = BATCH,
    miss: float = MISS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least linked doc_id), kept.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct runs of
    ``size`` words, or the whole shorter text; sets link from a Jaccard similarity of ``percent``. A pair
    at exactly that similarity shares no band once in (1 - t^rows)^bands, 1 in 20,000 by default.
    Null and empty texts have no shingles and link with nothing. Rows repeated with their doc_id
    return each. A null doc_id is never a component_id unless a component has no other. Only doc_id
    and text are read. An empty table gives no rows.
    """
    signed, named = grouped_nodes(docs, size, percent, bands, rows, batch, miss)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(named, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def repeated_nodes(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    batch: int = BATCH,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, node) of the rows that are not their component's one, by least doc_id, null last, and node.

    A row is known by both, so that null and repeated ids share no verdict; rows that are equal in both do, and
    have ``copies`` over 1 where one of them is to stay (``stays``). Rows without shingles are in no component.
    """
    signed, named = grouped_nodes(docs, size, percent, bands, rows, batch, miss)
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("node").alias("at"))
    least = cut_lineage(named.groupBy("root").agg(F.min(order).alias("least")))
    first = named.select("node", "root").join(least, "root").select("node", "least")
    counts = signed.where("node is not null").groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    verdict = counts.join(first, "node").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("node") == F.col("least.at"))
    )
    return verdict.where("not stays or copies > 1").select("doc_id", "node", "stays", "copies")


def _verified(pairs, nodes, texts, size, percent, batch, miss, n) -> DataFrame:
    likely = bayes_filter(pairs, nodes, percent, batch, miss, n)
    return cut_lineage(confirm(likely, texts, size, percent))


def _texts_of(docs: DataFrame, member: DataFrame, size: int) -> DataFrame:
    """(node, text) of the member nodes, one text each; a doc_id may stand for several texts."""
    wanted = member.select("doc_id", F.col("node").alias("wanted"))
    found = joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), bounded_side(wanted), "doc_id")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for i, (node, distinct) in enumerate(zip(rows.column(0).to_pylist(), _sets(rows.column(1), size), strict=True)):
                digest = hashlib.blake2b(distinct.tobytes(), digest_size=8).digest()
                if int.from_bytes(digest, "little", signed=True) == node:
                    keep.append(i)
            yield rows.take(pa.array(keep, pa.int64()))

    right = found.select(F.col("wanted").alias("node"), "text").mapInArrow(same, "node long, text string")
    # rows repeated with their doc_id
    return right.dropDuplicates(["node"]) if _repeats(docs) else right


def _repeats(docs: DataFrame) -> bool:
    counts = docs.groupBy("doc_id").count().where("count > 1")
    return not counts.isEmpty()
