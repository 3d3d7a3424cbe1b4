"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their leading bytes, of its bigrams and
of pairs of words with one between. Each weight has its own learning rate, and the L1 term holds
rare ones at zero, so that the model is a few thousand (index, weight) pairs, sent with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import crc_fold, small_batches
from rimlight.llm.labelled import FOLDS, training_sample
from rimlight.llm.text import U64, Words, mix, scan_words, text_buffers

BITS = 20
STEM = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
MAX_ROWS, EPOCHS = 12_000, 2
SHORT, SKIP, HEAD = U64(0x8CB92BA72F3D8DD7), U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)


def gram_indices(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, text) of every gram of several texts."""
    h = words.hash
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    two, three = text[1:] == text[:-1], text[2:] == text[:-2]
    grams = [h, words.stem * HEAD, (h[:-1] * SHORT + h[1:])[two], (h[:-2] * SKIP + h[2:])[three]]
    places = [text, text, text[1:][two], text[2:][three]]
    return (mix(np.concatenate(grams)) >> U64(64 - bits)).astype(np.int64), np.concatenate(places)


def fit_ftrl(
    rows: list[np.ndarray], labels: list[int], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        scale = (beta + np.sqrt(n[i])) / alpha + l2
        return np.where(np.abs(zi) <= np.where(i == bias, 0, l1), 0.0, (np.sign(zi) * np.where(i == bias, 0, l1) - zi) / scale)

    for _ in range(epochs):
        for idx, y in zip(rows, labels, strict=True):
            i = np.append(idx, bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.arange(bias)
    w = weights(every)
    used = np.flatnonzero(w)
    return used, w[used], float(weights(np.array([bias]))[0])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = EPOCHS,
    bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on about ``max_rows`` labelled rows outside fold 0. Without any, all weights are zero."""
    small_batches(docs.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            ys += batch.column(1).to_pylist()
            for _, data, at in text_buffers(batch.column(0)):
                index, text = gram_indices(scan_words(data, at, STEM), bits)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(at)))
                index = index[order]
                rows += [np.unique(index[cuts[k] : cuts[k + 1]]).astype(np.int32) for k in range(len(at) - 1)]
        used, w, b = fit_ftrl(rows, ys, bits, epochs, alpha, beta, l1, l2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(w, b), pa.float64())], ["i", "w"]
        )

    sample = training_sample(docs, labels, label, max_rows)
    # at most 2^bits + 1 pairs come back
    got = sample.mapInArrow(fit, "i long, w double").toPandas()
    model = got[got.i >= 0].sort_values("i")
    return model.i.to_numpy(), model.w.to_numpy(), float(got.w[got.i < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """(key, score) of each whole text; null and empty texts have the bias alone."""
    small_batches(docs.sparkSession)
    used, values, bias = model
    shipped = docs.sparkSession.sparkContext.broadcast((used, values.astype(np.float64)))
    schema = docs.select(key).schema.add("score", "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        dense[shipped.value[0]] = shipped.value[1]
        for batch in batches:
            for low, data, at in text_buffers(batch.column(1)):
                index, text = gram_indices(scan_words(data, at, STEM), bits)
                known = dense[index] != 0
                once = np.unique(text[known] * (1 << bits) + index[known])
                total = np.bincount(once >> bits, dense[once & ((1 << bits) - 1)], len(at) - 1) + bias
                out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(at) - 1), pa.array(out)], [key, "score"])

    return docs.select(key, F.col("text").cast("string")).mapInArrow(apply, schema)


def scored_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5).

    Labels of fold 0 (crc32 of the id's text modulo 5) are never read. Only doc_id and text are read.
    Repeated rows return each; a null doc_id is in fold 0; null and empty texts score the bias.
    """
    return (
        score(docs, train(docs, labels, **options))
        .withColumn("held_out", crc_fold(FOLDS) == 0)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .select("doc_id", "held_out", "score", "predicted")
    )


