"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.llm import exact_dedup, minhash_dedup, packing, quality, toxicity
from rimlight.llm.common import bounded_side, cut_lineage, table


def _spare(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``docs`` has it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _scored_in_place(docs: DataFrame, scorer, model, keep) -> DataFrame:
    """Rows whose score ``keep`` accepts. The row travels with its score, so no join is needed."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    scored = scorer(row, model, key="_row")
    return scored.where(keep(F.col("score"))).select(*[F.col("_row")[c].alias(c) for c in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5.

    Null and empty texts have the model's score without features, repeated rows have equal scores and share their fate,
    all columns stay. An empty table gives no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored_in_place(docs, toxicity.score, model, lambda s: s < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; odd rows as in ``drop_toxic``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored_in_place(docs, quality.score, model, lambda s: s >= quality.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; of rows repeated with their doc_id, one.

    The rows that go are the fewer, so these are joined: sent if their count is small, else shuffled. Null texts count as
    empty, null ids as one id; all columns stay, whatever they are called. An empty table gives no rows.
    """
    name = _spare(docs, "_digest")
    groups = cut_lineage(exact_dedup.exact_groups(docs).withColumnRenamed("text_sha256", "_digest"))
    gone = cut_lineage(groups.where(~F.col("kept")).select("doc_id", "_digest").distinct())
    repeated = groups.where("kept").groupBy("doc_id", "_digest").count().where("count > 1")
    digest = F.lower(F.hex(exact_dedup.sha256_bytes(exact_dedup.without_spaces(F.col("text")))))
    left, right = docs.withColumn(name, digest), bounded_side(gone.withColumnsRenamed({"doc_id": "_id", "_digest": "_at"}))
    same = left["doc_id"].eqNullSafe(right["_id"]) & (left[name] == right["_at"])
    rest = left.join(right, same, "left_anti")
    if not repeated.isEmpty():
        rest = rest.dropDuplicates(["doc_id", name])
    return rest.drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near-duplicate links connect: that of the least doc_id, null last.

    Rows are told apart by their doc_id and shingle set, as null and repeated ids stand for several texts. Texts without
    words, null ones too, all stay; all columns stay, whatever they are called. An empty table gives no rows.
    """
    name = _spare(docs, "_node")
    extra = cut_lineage(minhash_dedup.repeated_nodes(docs).withColumnsRenamed({"doc_id": "_id", "node": "_at"}))
    rows = docs.withColumn(name, minhash_dedup.node_of(F.col("text")))
    gone = bounded_side(cut_lineage(extra.where("not stays").select("_id", "_at")))
    rest = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (rows[name] == gone["_at"]), "left_anti")
    if not extra.where("stays").isEmpty():
        # several rows have the id and the shingle set of the one that stays; each text without words stays
        node = F.col(name)
        rest = rest.where(node.isNull()).unionByName(rest.where(node.isNotNull()).dropDuplicates(["doc_id", name]))
    return rest.drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document stands in which bin. A null or empty text takes one token's room; repeated rows stand
    apart. An empty table gives no rows."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Learned scores and near-duplicate groups cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
