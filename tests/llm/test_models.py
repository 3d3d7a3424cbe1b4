import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rimlight.llm import brown_lm, quality, toxicity
from rimlight.llm.text import scan_words, shingle_hashes, text_buffers


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A b  c", None, "", "b\x0bA\n", "c" * 3_000_000 + " a", " a b "]
    seen = {}
    for low, data, at in text_buffers(pa.array(texts)):
        words = scan_words(data, at, 4)
        for k in range(len(at) - 1):
            expect = (texts[low + k] or "").encode().lower().split()
            got = words.hash[words.first[k] : words.first[k + 1]]
            assert len(got) == len(expect)
            for w, h in zip(expect, got, strict=True):
                assert seen.setdefault(w, h) == h
        hashes, offsets = shingle_hashes(words, 4)
        assert len(hashes) == offsets[-1]
    assert len(set(seen.values())) == len(seen)


def check_scores(module, toy, odd_docs, no_docs, label):
    docs, labels = toy
    rows = {r.doc_id: r for r in module.scored_documents(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 600 and all(rows[i].held_out for i in held) and len(held) > 60
    right = sum(rows[i].predicted == truth.get(i) for i in held if i in truth)
    assert right >= 0.95 * sum(i in truth for i in held)
    odd = module.scored_documents(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert module.scored_documents(no_docs, labels).count() == 0
    none = module.scored_documents(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity_on_held_out_rows(toy, odd_docs, no_docs):
    check_scores(toxicity, toy, odd_docs, no_docs, "toxic")


def test_quality_on_held_out_rows(toy, odd_docs, no_docs):
    check_scores(quality, toy, odd_docs, no_docs, "quality")


def test_base_score_and_counts_equal_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in odd_docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    counts = Counter(w for i, ws in rows if fold(i) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expect = sorted(
        (str(i), len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4))
        for i, ws in rows
    )
    got = brown_lm.score_documents(odd_docs, sent_words=50).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == expect
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert brown_lm.score_documents(no_docs).count() == 0


def test_words_outside_the_core_get_classes_by_their_contexts(spark):
    # two word sets that follow each other; all words have one ending, and the core has four words
    rng = random.Random(4)
    sets = [[f"{s}{i}zz" for i in range(120)] for s in "xy"]
    word = lambda k: sets[k][0 if rng.random() < 0.4 else rng.randrange(2, 120)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    texts = {i: " ".join(word(k % 2) for k in range(40)) for i in range(700) if fold(i) != 2}
    held = [i for i in range(700) if fold(i) == 2][:2]
    rare = lambda k, n: sets[k][20 + n]
    texts[held[0]] = " ".join(rare(k % 2, k // 2) for k in range(40))
    texts[held[1]] = " ".join(rare(k // 20, k % 20) for k in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for sent_words in (30, 10_000):
        got = {r.doc_id: r.score for r in brown_lm.score_documents(docs, n_words=4, classes=4, sent_words=sent_words).collect()}
        # the same words, in the order of the training texts and grouped
        assert got[held[0]] > got[held[1]] + 10


def test_exchange_finds_the_classes_of_a_cycle():
    # unit 0 is the end; words of class A follow those of B and the other way round
    counts = np.zeros((9, 9))
    for a in range(1, 5):
        for b in range(5, 9):
            counts[a, b], counts[b, a] = 5 + 3 * a + b, 20 - a * b % 7
    counts[0, 1:5] = counts[5:9, 0] = 5
    classes = brown_lm.exchange(counts, 3, 10)
    assert len(set(classes[1:5])) == 1 and len(set(classes[5:9])) == 1 and len(set(classes)) == 3


def test_no_single_move_of_a_unit_raises_the_likelihood():
    rng = np.random.default_rng(6)
    counts = rng.poisson(3, (14, 14)) * rng.integers(0, 2, (14, 14)) * 4.0
    classes = brown_lm.exchange(counts, 4, 50)

    def likelihood(cls):
        member = np.eye(4)[cls]
        n = member.T @ counts @ member
        h = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return h(n) - h(n.sum(axis=0)) - h(n.sum(axis=1))

    best = likelihood(classes)
    for u in range(1, 14):
        for k in range(1, 4):
            other = classes.copy()
            other[u] = k
            assert likelihood(other) <= best + 1e-6


def test_sweeps_in_spark_never_lower_the_likelihood(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[2 * rng.integers(0, 30) + k % 2] for k in range(30)) for _ in range(80)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    hashes = brown_lm.with_ends(scan_words(*next(x[1:] for x in text_buffers(pa.array([" ".join(words)])))))[0]
    hashes = np.append([np.uint64(brown_lm.END)], hashes[:-1])
    shipped = spark.sparkContext.broadcast((hashes, np.ones(61, np.int64), np.arange(61)))
    sides = brown_lm.cut_lineage(brown_lm.neighbour_counts(train, shipped, 62))
    # counts of neighbours are those of the texts, from either side
    index = {w: i + 1 for i, w in enumerate(words)}
    counts = np.zeros((62, 62))
    for t in texts:
        at = [0, *(index[w] for w in t.split()), 0]
        np.add.at(counts, (at[:-1], at[1:]), 1)
    for r in sides.collect():
        row = np.bincount(np.frombuffer(r.v0, np.int32), np.frombuffer(r.n0, np.int64), 62)
        column = np.bincount(np.frombuffer(r.v1, np.int32), np.frombuffer(r.n1, np.int64), 62)
        assert (row == counts[r.u]).all() and (column == counts[:, r.u]).all()
    cls, between, steps = brown_lm.exchange_sweeps(sides, 62, 5, 6, parts=4)
    assert len(steps) > 2 and all(b > a for a, b in zip(steps, steps[1:], strict=False))
    onehot = np.eye(6)[cls]
    assert (onehot.T @ counts @ onehot == between).all() and cls[0] == 0 and cls[61] == 5
    assert set(cls[1:61:2]).isdisjoint(cls[2:61:2])
