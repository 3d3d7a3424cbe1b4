import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

DOCS = "doc_id long, text string, source string, score double, _key string, node long"


def words(rng, n, pool="abcdefgh"):
    return " ".join(rng.choice(pool) + rng.choice(pool) + rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, near copies; columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "zzz"
    long = words(rng, 30_000)
    texts = [
        (1, base), (2, " ".join(near)), (3, base.upper().replace(" ", "\n")), (4, None), (5, ""), (6, " \t"), (7, long),
        (8, long + " end"), (9, "one two"), (10, "one  two"), (10, "one  two"), (None, words(rng, 40)), (12, "é" * 10),
        (13, words(rng, 120)), (14, "x" * 70_000),
    ]
    rows = [(i, t, None if k % 4 == 0 else f"s{k % 3}", 0.5, "k", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def toy(spark):
    """Documents and labels: toxic ones hold a marked stem, bad ones shout."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = i % 7 == 0, i % 5 == 1
        text = words(rng, 40).split()
        if toxic:
            for _ in range(4):
                text[rng.randrange(40)] = "vile" + rng.choice("abcdefgh")
        text = [t.upper() + "!!" for t in text] if bad else text
        rows.append((i, " ".join(text), "s", 0.0, "k", 0))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
