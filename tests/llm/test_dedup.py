import hashlib
import re

from pyspark.sql import functions as F

from rimlight.llm.components import components
from rimlight.llm.exact_dedup import exact_groups
from rimlight.llm.minhash_dedup import least_matches, near_duplicates


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        key = re.sub("[ \t\n\x0b\x0c\r]", "", t or "")
        best = min(groups[key])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_groups_equal_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in exact_groups(odd_docs).collect()]
    assert sorted(map(str, got)) == brute_exact(rows)
    assert exact_groups(no_docs).count() == 0


def test_contents_are_compared_when_digests_collide(odd_docs):
    weak = exact_groups(odd_docs, digest=lambda c: F.lit(b"x")).drop("text_sha256")
    plain = exact_groups(odd_docs).drop("text_sha256")
    assert sorted(map(str, weak.collect())) == sorted(map(str, plain.collect()))


def test_exact_plan_is_native_and_salted(odd_docs):
    plan = exact_groups(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_near(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]) and sets[b]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(map(str, out))


def test_near_duplicates_equal_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in near_duplicates(odd_docs, 4).collect()]
    assert sorted(map(str, got)) == brute_near(rows, 4, 80)
    assert near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_spread_group(spark):
    """Copies of one text with more and more changes: links between them, not only to the original."""
    import random

    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in rng.sample(range(80), rng.randrange(5)):
            text[k] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()]
    assert sorted(map(str, got)) == brute_near(rows, 3, 80)


def test_bounds_of_the_sequential_test():
    bounds = least_matches(125, 25, 80, 1e-9)
    assert len(bounds) == 5 and bounds == sorted(bounds) and 0 < bounds[-1] < 100
    assert least_matches(125, 25, 80, 1.1) == [0] * 5


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (31, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(32)} == {0} and {got[k] for k in range(100, 120)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
