"""Conversation structure repair: the cheapest edits that make a conversation well formed, in linear space.

A repaired conversation is empty, or one system turn at most and then user and assistant turns in pairs. While its rows
are read it is in one of four states: nothing yet, after the system turn, after a user turn, after an assistant
turn. A row and the insertions before it are a unit, which takes each state to each other one at some cost and by
some string of edits; strings that take a state to different ones differ, and none begins another.

Hirschberg's divide and conquer finds the states between the units: costs of all states forward from the start and
backward from the end meet in the middle, the crossing with the least sum is taken, of equal ones that with the
least string before it, and both halves are solved alike. The forward vector carries beside each cost the rank of its
string among the four, which a step renews without the strings, so a vector is all that is held.

A run of rows is a unit too, with a table of 4 x 4 costs and ranks. So a conversation of any length is cut into
chunks in its order, whose tables are made in parallel; the same divide and conquer over the tables gives the
states between the chunks, and then each chunk is solved by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import cut_lineage, ship_package
from rimlight.llm.ordered_digest import ordered_digests

# The states, the role that an inserted or renamed row takes in each, the costs of the edits.
START, SYSTEM, USER, ASSISTANT = range(4)
TURNS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Inserted rows that end a conversation from each state.
TAIL = (0, 2, 1, 0)
# Bits of a row's code: its role's initial (other, s, u, a), must go, cut short.
INITIALS = ("", "s", "u", "a")
MUST_GO, CUT_SHORT = 4, 8
NEVER = 1 << 60
# Rows of a chunk; codes up to that length are solved once per task.
CHUNK, REMEMBERED = 16_384, 64
SPACES = " \t\n\x0b\x0c\r"

Table = tuple[tuple[tuple[int, int], ...], ...]


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial and state != {"u": USER, "a": ASSISTANT}[initial]:
        after = TURNS[state]
        return after if ROLES[after][0] == initial else None
    return None


@lru_cache(maxsize=16)
def row_unit(code: int) -> tuple[Table, dict[tuple[int, int], str]]:
    """((cost, rank) from each state to each, string of the edits) of a row and the insertions before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if code & CUT_SHORT else 0
    for state in range(4):
        at = state
        for inserted in range(4):
            ends = [(at, DELETE, "D")]
            if not code & MUST_GO:
                ends.append((TURNS[at], REROLE + extra, "R"))
                kept = _kept(at, INITIALS[code & 3])
                if kept is not None:
                    ends.append((kept, KEEP + extra, "K"))
            for to, cost, edit in ends:
                found = INSERT * inserted + cost, "I" * inserted + edit
                best[state, to] = min(best.get((state, to), found), found)
            at = TURNS[at]
    strings = {key: s for key, (_, s) in best.items()}
    table = []
    for state in range(4):
        order = sorted(to for to in range(4) if (state, to) in best)
        order.sort(key=lambda to: strings[state, to])
        table.append(tuple((best[state, to][0], order.index(to)) if to in order else (NEVER, 0) for to in range(4)))
    return tuple(table), strings


def forward(vector: list[tuple[int, int]], table: Table) -> list[tuple[int, int]]:
    """(cost, rank) of each state after a unit."""
    found = []
    for to in range(4):
        cost, rank, of = min((vector[s][0] + table[s][to][0], vector[s][1], s) for s in range(4))
        found.append((min(cost, NEVER), (rank, table[of][to][1])))
    order = sorted(x[1] for x in found if x[0] < NEVER)
    return [(cost, order.index(string) if cost < NEVER else 0) for cost, string in found]


def backward(vector: list[int], table: Table) -> list[int]:
    """Least cost to the end of each state before a unit."""
    return [min(NEVER, *(table[s][to][0] + vector[to] for to in range(4))) for s in range(4)]


def _only(state: int) -> list[tuple[int, int]]:
    return [(0 if s == state else NEVER, 0) for s in range(4)]


def crossings(tables: list[Table], start: int, ends: list[int]) -> list[int]:
    """The states before, between and after the units, from ``start``, with the cost of each state at the end."""
    states = [start] * (len(tables) + 1)
    vector = _only(start)
    for table in tables:
        vector = forward(vector, table)
    states[-1] = _meet(vector, ends)
    spans = [(0, len(tables))]
    while spans:
        low, high = spans.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = _only(states[low])
        for k in range(low, middle):
            vector = forward(vector, tables[k])
        rest = [0 if s == states[high] else NEVER for s in range(4)]
        for k in range(high - 1, middle - 1, -1):
            rest = backward(rest, tables[k])
        states[middle] = _meet(vector, rest)
        spans += [(low, middle), (middle, high)]
    return states


def _meet(vector: list[tuple[int, int]], rest: list[int]) -> int:
    return min(range(4), key=lambda s: (min(vector[s][0] + rest[s], NEVER), vector[s][1], s))


def chunk_table(codes: bytes) -> Table:
    """The unit of a run of rows."""
    return _table(codes) if len(codes) <= REMEMBERED else _table.__wrapped__(codes)


@lru_cache(maxsize=65_536)
def _table(codes: bytes) -> Table:
    out = []
    for state in range(4):
        vector = _only(state)
        for code in codes:
            vector = forward(vector, row_unit(code)[0])
        out.append(tuple(vector))
    return tuple(out)


def chunk_edits(codes: bytes, start: int, end: int) -> list[str]:
    """The edits of each row of a chunk, with the insertions before it, between two known states."""
    return list(_edits(codes, start, end) if len(codes) <= REMEMBERED else _edits.__wrapped__(codes, start, end))


@lru_cache(maxsize=65_536)
def _edits(codes: bytes, start: int, end: int) -> tuple[str, ...]:
    units = [row_unit(code) for code in codes]
    states = crossings([u[0] for u in units], start, [0 if s == end else NEVER for s in range(4)])
    return tuple(u[1][a, b] for u, a, b in zip(units, states, states[1:], strict=False))


def _chunks(marked: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, codes, rids, low, high, turns, gap) of rows in order; a chunk is part of one conversation.

    ``turns`` counts the different turns of the chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] | None = None

        def of(x: list[np.ndarray], whole: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            """Chunks of the rows; the last one waits for more unless ``whole``."""
            nonlocal number
            n = len(x[0])
            new = np.ones(n, bool)
            new[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
            head = np.flatnonzero(new)
            since = np.arange(n) - head[np.cumsum(new) - 1]
            head = np.flatnonzero(since % chunk == 0)
            ends = np.append(head[1:], n)
            if not whole:
                head, ends = head[:-1], ends[:-1]
            rest = [c[ends[-1] if len(ends) else 0 :] for c in x]
            out = []
            for a, b in zip(head.tolist(), ends.tolist(), strict=True):
                turns = x[2][a:b][~x[3][a:b]]
                some = len(turns) > 0
                out.append((None if x[1][a] else int(x[0][a]), number, x[4][a:b].tobytes(), x[5][a:b].tobytes(),
                            int(turns[0]) if some else None, int(turns[-1]) if some else None,
                            1 + int((turns[1:] != turns[:-1]).sum()) if some else 0))
                number += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "chunk", "codes", "rids", "low", "high", "turns"]), rest

        for batch in batches:
            conv, turn, code, rid = batch.columns
            now = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in (conv, turn)]
            gone = [c.is_null().to_numpy(zero_copy_only=False) for c in (conv, turn)]
            now = [now[0], gone[0], now[1], gone[1], code.to_numpy(zero_copy_only=False).astype(np.uint8), rid.to_numpy(zero_copy_only=False)]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now, strict=True)]
            made, held = of(now, False)
            yield made
        if held is not None and len(held[0]):
            yield of(held, True)[0]

    schema = "conv_id long, chunk long, codes binary, rids binary, low long, high long, turns long"
    order = ["conv_id", "turn", "role", "digest", "rid"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "code", "rid").mapInArrow(cut, schema)


SUMMARY = "conv_id long, chunk long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first int, last int, costs array<long>"


def _summaries(chunks: DataFrame) -> DataFrame:
    """What the whole conversation needs of each chunk, in some hundred bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for codes in batch.column(2).to_pylist():
                x = np.frombuffer(codes, np.uint8)
                blank, twice = (x & 16 > 0).sum(), ((x & MUST_GO > 0) & (x & 16 == 0)).sum()
                table = chunk_table(bytes(x & 15))
                figures = (blank, twice, (x & CUT_SHORT > 0).sum(), sum(map(_illegal, x[:-1] & 3, x[1:] & 3)), x[0] & 3, x[-1] & 3)
                for column, value in zip(out, figures, strict=False):
                    column.append(int(value))
                out[6].append([v for row in table for pair in row for v in pair])
            arrays = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64())], strict=True)]
            names = ["conv_id", "chunk", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 4, 5, 6)), *arrays], names)

    return chunks.mapInArrow(of, SUMMARY)


def _illegal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] not in ("su", "ua", "au")


def _joined(summaries: DataFrame) -> DataFrame:
    """States around each chunk; with the first chunk of a conversation, its figures.

    A conversation's summaries meet in a task: an audit is one value, so it has some 130,000 of them at most."""

    def solve(held: list[dict]) -> list[tuple]:
        tables = [tuple(tuple(zip(c[s * 8 : s * 8 + 8 : 2], c[s * 8 + 1 : s * 8 + 8 : 2], strict=True)) for s in range(4)) for c in (h["costs"] for h in held)]
        states = crossings(tables, START, [INSERT * n for n in TAIL])
        cost = sum(t[a][b][0] for t, a, b in zip(tables, states, states[1:], strict=False)) + INSERT * TAIL[states[-1]]
        turns = [(h["low"], h["high"]) for h in held if h["low"] is not None]
        again = sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        gaps = turns[-1][1] - turns[0][0] + 1 - sum(h["turns"] for h in held) + again if turns else 0
        illegal = sum(h["illegal"] for h in held) + sum(_illegal(a["last"], b["first"]) for a, b in zip(held, held[1:], strict=False))
        sums = [sum(h[name] for h in held) for name in ("blank", "duplicate", "truncated")]
        out = []
        for k, h in enumerate(held):
            last = k + 1 == len(held)
            figures = (gaps, *sums, illegal, cost) if k == 0 else (None,) * 6
            out.append((h["conv_id"], h["chunk"], states[k], states[k + 1], TAIL[states[-1]] if last else 0, *figures))
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield packed(out)
        yield packed(solve(held) if held else [])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
        names = ["conv_id", "chunk", "start", "end", "tail", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "conv_id long, chunk long, start int, end int, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return summaries.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(of, schema)


STEPS = "array<struct<rid:long,role:string>>"


def _solved(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, audit, steps): the edits of each chunk, and the rows that remain: kept ones by their rid, with
    a new role if they get one, and inserted ones."""
    kind = pa.list_(pa.struct([("rid", pa.int64()), ("role", pa.string())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, steps = [], []
            for codes, rids, start, end, tail in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                edits = chunk_edits(bytes(np.frombuffer(codes, np.uint8) & 15), start, end)
                rids = np.frombuffer(rids, np.int64).tolist()
                state, out = start, []
                for rid, code, edit in zip([*rids, None], [*codes, 0], [*edits, "I" * tail], strict=True):
                    for step in edit:
                        if step in "IR":
                            state = TURNS[state]
                            out.append({"rid": rid if step == "R" else None, "role": ROLES[state]})
                        elif step == "K":
                            state = _kept(state, INITIALS[code & 3])
                            out.append({"rid": rid, "role": None})
                audits.append("".join(edits) + "I" * tail)
                steps.append(out)
            arrays = [batch.column(0), batch.column(1), pa.array(audits, pa.string()), pa.array(steps, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "chunk", "audit", "steps"])

    return chunks.mapInArrow(of, f"conv_id long, chunk long, audit string, steps {STEPS}")


def repair(conversations: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(report, rows): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation; and
    the repaired rows: conv_id, chunk, place (in this order), role, text.

    Rows are taken by turn, null first, equal turns by role and then by the SHA-256 of their text. A null role or
    text is one space; a null conv_id is a conversation like others. Gaps count the turns missing between the
    least and the greatest, nulls apart. A row's first fault counts: blank (nothing but ASCII white space), duplicate
    (its role and text came before in the conversation), truncated (its last other character is none of ``.!?``). Illegal
    are neighbours whose roles do not begin with s u, u a or a u. The audit has one letter for each edit: Keep,
    Rerole, Delete, Insert; of equally cheap ones it is the least string. An empty table gives no rows. Only
    conv_id, turn, role and text are read, so further columns may have any name.
    """
    ship_package(conversations.sparkSession)
    blankless = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *blankless)
    # numbered once, so that all that follows means the same rows
    rows = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))
    ended = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = sum((F.when(initial == INITIALS[k], k).otherwise(0) for k in (1, 2, 3)), F.lit(0))
    marked = rows.select(
        "rid", "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), code.alias("initial"),
        (ended == "").alias("blank"), F.substring(ended, -1, 1).isin(".", "!", "?").alias("ended"),
    )
    came = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "rid"))["rid"].alias("first")
    first = marked.groupBy("conv_id", "role", "digest").agg(came).select(F.col("first").alias("rid"), F.lit(True).alias("first"))
    marked = marked.join(first, "rid", "left")
    fault = (
        F.when(F.col("blank"), MUST_GO | 16)
        .when(F.col("first").isNull(), MUST_GO)
        .when(~F.col("ended"), CUT_SHORT)
        .otherwise(0)
    )
    marked = marked.select("conv_id", "turn", "role", "digest", "rid", (F.col("initial") + fault).alias("code"))
    chunks = cut_lineage(_chunks(marked, chunk))
    around = cut_lineage(_joined(_summaries(chunks)))
    solved = cut_lineage(
        _solved(chunks.select("conv_id", "chunk", "codes", "rids").join(around.select("chunk", "start", "end", "tail"), "chunk")
                .select("conv_id", "chunk", "codes", "rids", "start", "end", "tail"))
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"])
    audits = solved.groupBy("conv_id").agg(F.array_join(pieces, "").alias("audit"))
    figures = around.where("cost is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = (
        figures.unionByName(audits, allowMissingColumns=True)
        .groupBy("conv_id")
        .agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
    )
    steps = solved.select("conv_id", "chunk", F.posexplode("steps").alias("place", "step"))
    steps = steps.select("conv_id", "chunk", "place", "step.rid", F.col("step.role").alias("new"))
    texts = rows.select("rid", "role", "text")
    kept = steps.where("rid is not null").join(texts, "rid").select(
        "conv_id", "chunk", "place", F.coalesce("new", "role").alias("role"), "text"
    )
    added = steps.where("rid is null").select("conv_id", "chunk", "place", F.col("new").alias("role"), F.lit("").alias("text"))
    return report, kept.unionByName(added)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with made faults, by crc32(``conv_id:turn``) % 20, null being one space: 0 is dropped, 1 gets an empty text,
    2 loses its ``.!?``, 3 comes twice, 4 gets the role user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = (F.crc32(name.cast("binary")) % 20).alias("fate")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *text, fate).where("fate != 0")
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(times)).drop("col")


def repair_report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``repair`` of the damaged rows: one row for each conv_id given, with repaired_sha256, of the repaired
    ``role:text`` joined by newlines. A conversation without rows left has zeros and empty strings."""
    report, rows = repair(damaged(conversations), chunk)
    key = F.col("conv_id").cast("string").alias("key")
    lines = rows.select(key, "chunk", "place", F.concat("role", F.lit(":"), "text").alias("value"))
    digests = ordered_digests(lines, ["chunk", "place"], "\n").select(F.col("key").cast("long").alias("conv_id"), "sha256")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    whole = (
        ids.unionByName(report, allowMissingColumns=True)
        .unionByName(digests, allowMissingColumns=True)
        .groupBy("conv_id")
        .agg(*[F.max(c).alias(c) for c in (*report.columns[1:], "sha256")])
    )
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in report.columns[1:-1]]
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
