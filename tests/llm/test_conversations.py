"""Conversation repair and the prefix trie against plain Python over whole small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimlight.llm import conversation_repair as repair
from rimlight.llm import prefix_trie as trie
from rimlight.llm.ordered_digest import ordered_digests

ROWS = "conv_id long, turn long, role string, text string, chunk long, key string, rid long, value string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}


def order(row):
    return tuple((x is None, x) for x in row)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows; one conversation has a third of all rows."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        conv = 5 if i % 3 == 0 else rng.choice([None, 1, 2, 3, 4, -7, -107, 100, 101, 10**12, 10**12 + 3, *range(300, 380)])
        turn = i if conv == 5 else rng.choice([None, *range(8)])
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "sx"])
        text = rng.choice(["hi.", "what?", "no", " \t", "", None, "ok. \n", "é!", "long " * 900 + ".", "a.b"])
        rows.append((conv, turn, role, text, 1, "k", 2, "v"))
    return spark.createDataFrame(rows + rows[:40], ROWS)


def cheapest(rows):
    """(cost, audit) of (initial, must go, truncated) rows: every state with its least cost and string."""
    states = {0: (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for s, (c, a) in list(out.items()):
                out[NEXT[s]] = min(out.get(NEXT[s], (10**9, "")), (c + 2, a + "I"))
        return out

    for initial, must_go, truncated in rows:
        new = {}
        for s, (c, a) in inserted(states).items():
            ways = [(s, c + 3, a + "D")]
            if not must_go:
                ways.append((NEXT[s], c + 2 + truncated, a + "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, s))
                ways += [(to, c + truncated, a + "K")] if to else []
            for to, cost, audit in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        states = new
    return min(x for s, x in inserted(states).items() if s in (0, 3))


def repaired(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            mine += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes, faults = set(), [], [0, 0, 0]
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            codes.append((role[:1], fault in (0, 1), int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(codes)
        state, lines, left = 0, [], iter(mine)
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                lines.append(ROLE[state] + ":")
                continue
            _, role, text = next(left)
            if edit in "RK":
                state = NEXT[state] if edit == "R" else {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append((ROLE[state] if edit == "R" else role) + ":" + text)
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=order)


@pytest.mark.parametrize("chunk", [repair.CHUNK, 3, 1])
def test_repair_equals_brute_force(odd_turns, chunk):
    found = sorted((tuple(r) for r in repair.repair_report(odd_turns, chunk).collect()), key=order)
    assert found == repaired(rows_of(odd_turns))


def test_repair_of_an_empty_table(spark):
    assert repair.repair_report(spark.createDataFrame([], ROWS)).collect() == []


def test_all_rows_dropped(spark):
    name = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = repair.repair_report(spark.createDataFrame([(*name, "user", "hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (name[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_of_every_short_conversation():
    kinds = [(i, m, t) for i in range(4) for m, t in ((0, 0), (1, 0), (0, 1))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            codes = bytes(i | repair.MUST_GO * m | repair.CUT_SHORT * t for i, m, t in rows)
            units = [repair.row_unit(c) for c in codes]
            states = repair.crossings([u[0] for u in units], 0, [repair.INSERT * k for k in repair.TAIL])
            audit = "".join(u[1][a, b] for u, a, b in zip(units, states, states[1:], strict=False)) + "I" * repair.TAIL[states[-1]]
            assert audit == cheapest([(repair.INITIALS[i], m, t) for i, m, t in rows])[1]


def test_crossings_of_chunks_are_those_of_rows():
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 6, 9, 10, 11]) for _ in range(rng.randrange(2, 90)))
        ends = [repair.INSERT * k for k in repair.TAIL]
        rows = repair.crossings([repair.row_unit(c)[0] for c in codes], 0, ends)
        step = rng.randrange(1, 9)
        pieces = [codes[i : i + step] for i in range(0, len(codes), step)]
        assert repair.crossings([repair.chunk_table(p) for p in pieces], 0, ends) == [*rows[:-1:step], rows[-1]]


def test_general_rows(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "yes."), (2, 0, "user", "one.")]
    report, kept = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.cost, r.audit) for r in report.collect()) == [(1, 4, "IKKI"), (2, 2, "KI")]
    lines = [(r.conv_id, r.role, r.text) for r in kept.orderBy("conv_id", "chunk", "place").collect()]
    assert lines == [(1, "user", ""), (1, "assistant", "hello."), (1, "user", "yes."), (1, "assistant", ""), (2, "user", "one."), (2, "assistant", "")]


def nodes_of(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, key, text))
    turns = {c: [(r[2], r[4]) for r in sorted(rs)] for c, rs in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members, children = {}, {}
    for c, mine in whole.items():
        for d in range(len(mine) + 1):
            members.setdefault(tuple(mine[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below, m = children.get(k, []), members[k]
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(m) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=order)


@pytest.mark.parametrize("options", [{}, {"range_rows": 40, "short": 20, "many": 2}])
def test_trie_equals_brute_force(odd_turns, options):
    found = sorted((tuple(r) for r in trie.build_trie(odd_turns, **options).collect()), key=order)
    assert found == nodes_of(rows_of(odd_turns))


def test_trie_of_shared_beginnings(spark):
    rows = [(c, t, "user", f"t{t if t < 3 else c % 7}") for c in range(1000, 1300) for t in range(c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in trie.build_trie(df).collect()), key=order) == nodes_of(rows)


def test_trie_of_nothing(spark):
    assert trie.build_trie(spark.createDataFrame([], ROWS)).collect() == []
    alone = spark.createDataFrame([(None, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert trie.build_trie(alone).collect() == []


def test_list_ranking_of_random_lists(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(700)
    rows = [(int(a), int(b), int(a) % 3, 1) for a, b in zip(names, [*names[1:], -1], strict=True)]
    lists = spark.createDataFrame(rows, trie.LIST)
    got = {r.arc: (r.leaves, r.saved) for r in trie.list_sums(lists, 700, short=30).collect()}
    assert got == {int(a): (sum(int(x) % 3 for x in names[i:]), 700 - i) for i, a in enumerate(names)}


def test_ordered_digests_over_partitions(spark):
    rows = [(str(i % 3) if i % 3 else None, i, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "key string, at long, value string").repartition(5)
    got = {r.key: r.sha256 for r in ordered_digests(df, ["at"], ",").collect()}
    for name in (None, "1", "2"):
        want = ",".join(v for k, _, v in rows if k == name)
        assert got[name] == hashlib.sha256(want.encode()).hexdigest()


def test_repaired_rows_follow_the_form(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!"])) for c in range(60) for t in range(rng.randrange(12))]
    _, kept = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "place", F.substring("role", 1, 1).alias("r")))).alias("x"))
    for r in whole.collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.r for x in r.x))
