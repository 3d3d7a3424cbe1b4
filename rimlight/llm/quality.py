"""Quality score: learned word and character n-gram vectors, averaged per document, softmax output.

Words and byte n-grams are hashed to rows of one table of vectors. A document is the mean of the
vectors of its features; a linear layer and softmax give the label. All is trained by stochastic
gradient descent in numpy. As mean and layer are linear, a feature's part in the score is one number,
so scoring needs a vector of these only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import crc_fold, small_batches
from rimlight.llm.labelled import FOLDS, training_sample
from rimlight.llm.text import IS_WORD, U64, running_sums, scan_words, span_hashes, text_buffers

WORD_BITS, GRAM_BITS = 17, 17
GRAMS = (2, 3, 4)
DIM, EPOCHS, RATE = 12, 4, 0.5
MAX_ROWS = 6_000
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, text) of each word and each n-gram inside a word or over its edge.

    Letters keep their case in the n-grams; white space counts as one and the same edge.
    """
    words = scan_words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    index = [(words.hash >> U64(64 - WORD_BITS)).astype(np.int64)]
    places = [text]
    if len(data):
        edge = ~IS_WORD[data]
        flat = np.where(edge, 32, data).astype(np.uint8)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        sums = running_sums(flat)
        for n in GRAMS:
            k = len(data) - n + 1
            if k <= 0:
                continue
            inside = np.zeros(k, bool)
            for j in range(1, n - 1):
                inside |= edge[j : j + k]
            inside |= (edge[:k] & edge[n - 1 :]) | (owner[:k] != owner[n - 1 :])
            begin = np.flatnonzero(~inside)
            hashes = span_hashes(sums, begin, begin + n)
            index.append((hashes >> U64(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS))
            places.append(owner[begin])
    return np.concatenate(index), np.concatenate(places)


def fit_vectors(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int, epochs: int, rate: float, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Each feature's part in the difference of the two logits, and the difference of the biases."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, ((1 << WORD_BITS) + (1 << GRAM_BITS), dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(epochs * len(rows), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            index, share = rows[i]
            hidden = share @ table[index]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            layer -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            # each feature's gradient is its share; the step is that of the largest share at most
            table[index] -= (lr * share / max(share.max(initial=0), 1e-9))[:, None] * back
    return table @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
    dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE,
) -> tuple[np.ndarray, float]:
    """Fit on about ``max_rows`` labelled rows outside fold 0. Without any, every score is 0.5."""
    small_batches(docs.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            ys += batch.column(1).to_pylist()
            for _, data, at in text_buffers(batch.column(0)):
                index, text = features(data, at)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(at)))
                index = index[order]
                for k in range(len(at) - 1):
                    distinct, count = np.unique(index[cuts[k] : cuts[k + 1]], return_counts=True)
                    rows.append((distinct.astype(np.int32), (count / max(count.sum(), 1)).astype(np.float32)))
        parts, bias = fit_vectors(rows, ys, dim, epochs, rate)
        yield pa.RecordBatch.from_arrays(
            [pa.array([parts.astype(np.float32).tobytes()]), pa.array([bias])], ["parts", "bias"]
        )

    sample = training_sample(docs, labels, label, max_rows)
    got = sample.mapInArrow(fit, "parts binary, bias double").first()  # one row of a megabyte
    if got is None:
        return np.zeros((1 << WORD_BITS) + (1 << GRAM_BITS), np.float32), 0.0
    return np.frombuffer(bytes(got.parts), np.float32), got.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id") -> DataFrame:
    """(key, score): softmax probability of label 1; texts without features have the bias alone."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(key).schema.add("score", "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bias = shipped.value
        for batch in batches:
            for low, data, at in text_buffers(batch.column(1)):
                index, text = features(data, at)
                n = len(at) - 1
                total = np.bincount(text, parts[index], n) / np.maximum(np.bincount(text, minlength=n), 1) + bias
                out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(out)], [key, "score"])

    return docs.select(key, F.col("text").cast("string")).mapInArrow(apply, schema)


def scored_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3).

    Labels of fold 0 (crc32 of the id's text modulo 5) are never read. Only doc_id and text are read.
    Repeated rows return each; a null doc_id is in fold 0; null and empty texts score the bias.
    """
    return (
        score(docs, train(docs, labels, **options))
        .withColumn("held_out", crc_fold(FOLDS) == 0)
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        .select("doc_id", "held_out", "score", "predicted")
    )
