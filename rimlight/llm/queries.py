"""Registered queries of the subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rimlight.llm import (
    brown_lm,
    conversation_repair,
    exact_dedup,
    hnsw,
    html_extract,
    materialise,
    minhash_dedup,
    packing,
    prefix_trie,
    quality,
    sentencepiece_codec,
    suffix_dedup,
    toxicity,
)
from rimlight.llm.common import table
from rimlight.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

# Shingles of the registered near-duplicate query, in words.
QUERY_SHINGLE = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": lambda s, d: minhash_dedup.near_duplicates(table(s, d, "documents"), QUERY_SHINGLE),
    "op2_toxicity": lambda s, d: toxicity.scored_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op3_html_extract": lambda s, d: html_extract.extract_text(table(s, d, "pages")),
    "op4_brown_lm": lambda s, d: brown_lm.score_documents(table(s, d, "documents")),
    "op5_best_fit_packing": lambda s, d: packing.packed_documents(table(s, d, "documents")),
    "op6_hnsw": lambda s, d: hnsw.nearest(table(s, d, "embeddings")),
    "op7_quality": lambda s, d: quality.scored_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op8_training_order": lambda s, d: materialise.materialised_documents(table(s, d, "documents")),
    "op9_sentencepiece": lambda s, d: sentencepiece_codec.coded_documents(table(s, d, "documents")),
    "op10_exact_dedup": lambda s, d: exact_dedup.exact_groups(table(s, d, "documents")),
    "op11_conversation_repair": lambda s, d: conversation_repair.repair_report(table(s, d, "conversations")),
    "op12_prefix_trie": lambda s, d: prefix_trie.build_trie(table(s, d, "conversations")),
    "op13_suffix_dedup": lambda s, d: suffix_dedup.repeat_report(table(s, d, "documents")),
    "pipeline": corpus_pipeline.run,
}
