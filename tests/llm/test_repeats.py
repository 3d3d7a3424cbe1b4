"""Removal of repeated passages against plain Python over all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rimlight.llm import suffix_dedup as repeats
from rimlight.llm.text import PIECE

DOCS = "doc_id long, text string, source string, score double, _key string, node long"
LAST = (1 << 63) - 1


def words(rng, n, pool="abcdefgh"):
    return " ".join(rng.choice(pool) + rng.choice(pool) + rng.choice(pool) for _ in range(n))


def order(row):
    return tuple((x is None, x) for x in row)


def brute_force(rows, length=50):
    first = {}
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for d, _, text in texts:
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, i, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=order)


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(8)
    passage, line = words(rng, 60), "same line of words in many texts, again and again. " * 3
    rows = [(i, words(rng, 30) + passage[: rng.randrange(20, 240)] + words(rng, 10)) for i in range(60)]
    rows += [(100 + i, line[i % 7 :] + words(rng, 3)) for i in range(50)]
    rows += [(200, "a" * 500), (201, "a" * 49), (202, "ab" * 60), (203, "é" * 70), (204, "xé" + "é" * 60), (205, "a" * 120), (206, passage)]
    rows += [(7, passage + line), (7, passage + line), (7, line), (None, passage), (None, passage), (None, words(rng, 90) + line), (300, None), (301, "")]
    rows += [(400 + i, passage[10:140]) for i in range(20)] + [(-5, line * 2), (500, words(rng, 40)), (501, " " * 80), (502, "\t" + " " * 60)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "s", 0.5, "k", k) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize(
    "options", [{}, {"max_sent": 0, "max_list": 0, "max_ids": 0}, {"chunk": 5, "hot": 2}, {"hot": 1}, {"length": 20, "gram": 6}, {"length": 30, "gram": 29}]
)
def test_equals_brute_force(odd_texts, options):
    rows = [(r.doc_id, r.text) for r in odd_texts.collect()]
    found = sorted((tuple(r) for r in repeats.repeat_report(odd_texts, **options).collect()), key=order)
    assert found == brute_force(rows, options.get("length", repeats.LENGTH))


def test_spans_and_kept_bytes(spark):
    shared = "0123456789" * 6
    rows = [(1, "first " + shared), (2, shared + " second"), (3, "x" + shared[:50] + "y" + shared[5:55])]
    found = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[2].spans] == [(0, 60)] and bytes(found[2].kept) == b" second"
    assert [tuple(s) for s in found[3].spans] == [(1, 51), (52, 102)] and bytes(found[3].kept) == b"xy"
    assert found[1].spans == [] and bytes(found[1].kept).decode() == rows[0][1]


def test_empty_table(no_docs):
    assert repeats.repeat_report(no_docs).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = words(rng, 700_000)
    assert len(long) > 2 * PIECE
    rows = [(1, long), (2, "intro " + long), (3, long[PIECE - 60 : PIECE + 60]), (4, words(rng, 20))]
    found = {r.doc_id: r for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[2].n_removed, found[2].n_spans) == (len(long), 1)
    assert found[3].n_removed == 120 and found[1].n_removed == 0 and found[4].n_removed == 0


def test_equal_windows_have_one_start_wherever_they_stand():
    rng = random.Random(6)
    shared = words(rng, 40) + "aaaa" * 30 + "abab" * 20
    column = pa.array([words(rng, 9) + shared, shared + words(rng, 5), "z" + shared])
    starts = []
    for _, at, runs in repeats.runs_of(column, 50, 16):
        for text in range(3):
            mine = np.flatnonzero(runs.text == text)
            where = column[text].as_py().index(shared) + at[text]
            found = {}
            for r in mine:
                for p in range(runs.first[r], runs.last[r] + 1):
                    found[p - where] = runs.start[r] - where
            starts.append([found[p] for p in range(len(shared) - 49)])
    assert starts[0] == starts[1] == starts[2]
