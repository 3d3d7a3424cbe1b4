"""Conversation prefix trie by the Euler-tour technique.

A node stands for the conversations that begin with the same turns. Its identity is its depth and a sum over its turns of
124 bits drawn from each turn's place and content, so the nodes along a conversation are running sums, made in
parallel; its name is its least conversation and its depth, which belong to no other node.

Each node gives the tour two arcs, one on entering and one on leaving it. The arc after an entry is that into the
first child, or the node's own exit; the arc after an exit is that into the next sibling, or the parent's exit. Siblings
follow one another by their least conversation. List ranking gives each arc the sums from it to the end of the tour;
what a node's subtree holds is the difference of its two arcs.

The ranking contracts first: a task follows the list inside its range of conversations, where most of it runs, and only
arcs that are entered from another range stay. A long contracted list is contracted on, to one arc in eight chosen
by a hash, by pointer jumping; a short one is ranked in a task. Then the sums are carried back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import bounded_side, cut_lineage, ship_package
from rimlight.llm.ordered_digest import ordered_digests
from rimlight.llm.text import U64, mix

BLOCK, HEADS = 100, 6
# Arcs that a task follows at once, arcs of a list that is ranked in one, children that make a parent hot.
RANGE, SHORT, MANY = 200_000, 16_384, 10_000
RULERS = 8
LANE = (1 << 62) - 1
ITEM = ["a", "b"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(batch, first rows of conversations, rows since, rows of the first one that came before in the task)."""
    last, since = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        head = np.flatnonzero(new)
        place = np.arange(len(conv)) - head[np.cumsum(new) - 1]
        carried = since if conv[0] == last else 0
        place[new.cumsum() == 1] += carried
        yield batch, new, place, carried
        last, since = conv[-1], place[-1] + 1


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, a, b, points) of each turn: its place in the conversation and 120 bits of its content."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch, _, place, _ in _segments(batches):
            arrays = [batch.column(0), pa.array(np.full(len(place), part, np.int32)), pa.array(place), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "idx", "a", "b", "points"])

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = [F.conv(F.substring(content, 1 + 15 * k, 15), 16, 10).cast("long").alias(c) for k, c in enumerate(ITEM)]
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), *half,
        F.char_length(text).cast("long").alias("points"), F.monotonically_increasing_id().alias("rid"),
    )
    order = ["conv_id", "turn", "role", "a", "b", "rid"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "points")
    found = cut_lineage(dealt.mapInArrow(number, "conv_id long, part int, idx long, a long, b long, points long"))
    # a conversation that goes on in another partition: one for each partition at most
    pieces = found.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.select("conv_id", "part", F.sum("n").over(before).alias("offset")).where("offset is not null")
    pos = F.col("idx") + F.coalesce("offset", F.lit(0))
    return found.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", "part", pos.alias("pos"), *ITEM, "points")


def rebuilt_turns(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, a, b, points) of rebuilt conversations, (conv_id, n_turns) of all).

    Conversation c takes the first h turns of c - c % ``block``, all if there are fewer, and then its own after its first
    h, h being crc32(c as text) % ``heads``."""
    own = cut_lineage(placed_turns(conversations))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    donor = (F.col("conv_id") - F.col("conv_id") % block).alias("donor")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    given = own.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads))
    lent = given.groupBy("conv_id").agg(F.count("*").alias("lent")).withColumnRenamed("conv_id", "donor")
    plan = convs.select("conv_id", "n", head, donor).join(lent, "donor", "left")
    plan = cut_lineage(plan.withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0)))))
    first = plan.where("h > 0").join(given.withColumnRenamed("conv_id", "donor"), "donor").where("pos < h")
    first = first.select("conv_id", (F.col("pos") + 1).alias("depth"), *ITEM, "points")
    # where a donor is short, what follows moves up; told to each piece of a conversation, as one may be most of the rows
    pieces = own.select("conv_id", "part").distinct()
    moved = pieces.join(plan.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("up")), "conv_id")
    moved = bounded_side(cut_lineage(moved))
    rest = own.withColumn("h", head).where("pos >= h").join(moved, ["conv_id", "part"], "left")
    rest = rest.select("conv_id", (F.col("pos") + 1 - F.coalesce("up", F.lit(0))).alias("depth"), *ITEM, "points")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return first.unionByName(rest), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, up_p, up_q, points): the node of each turn and that before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sums = [np.zeros(1, U64)] * 2
        for batch, new, place, carried in _segments(batches):
            depth = batch.column(1).to_numpy(zero_copy_only=False).astype(U64)
            out = []
            for k in range(2):
                item = batch.column(2 + k).to_numpy(zero_copy_only=False).astype(U64)
                drawn = mix(mix(item + U64(k)) + mix(depth)) & U64(LANE)
                total = np.cumsum(drawn, dtype=U64)
                base = (total - drawn)[new][np.cumsum(new) - 1]
                start = np.where(new.cumsum() == 1, sums[k] if carried else U64(0), U64(0))
                now = (total - base + start) & U64(LANE)
                out += [now, drawn]
                sums[k] = now[-1:]
            arrays = [batch.column(0), pa.array(np.full(len(place), part, np.int32)), batch.column(1), *(pa.array(x.view(np.int64)) for x in out), batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "depth", "p", "fp", "q", "fq", "points"])

    schema = "conv_id long, part int, depth long, p long, fp long, q long, fq long, points long"
    dealt = turns.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    found = cut_lineage(dealt.select("conv_id", "depth", *ITEM, "points").mapInArrow(run, schema))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = found.groupBy("conv_id", "part").agg(*[F.max_by(c, "depth").cast("decimal(38,0)").alias(c) for c in "pq"])
    later = total.select("conv_id", "part", *[(F.sum(c).over(before) % (LANE + 1)).cast("long").alias(f"o{c}") for c in "pq"])
    later = F.broadcast(later.where("op is not null"))  # one for each partition at most
    found = found.join(later, ["conv_id", "part"], "left")

    def lane(value: Column) -> Column:
        return value.bitwiseAND(F.lit(LANE))

    at = {c: lane(F.col(c) + F.coalesce(f"o{c}", F.lit(0))) for c in "pq"}
    up = [lane(at[c] - F.col(f"f{c}")).alias(f"up_{c}") for c in "pq"]
    return found.select("conv_id", "depth", at["p"].alias("p"), at["q"].alias("q"), *up, "points")


def trie_nodes(rows: DataFrame, lengths: DataFrame, many: int = MANY) -> DataFrame:
    """(nid, parent, depth, p, q, conv_id, parent_conv_id, n_convs, points): the nodes, the root first of all."""
    inner = rows.groupBy("depth", "p", "q").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("up_p", "up_q", "points")],
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("p", "q", "up_p", "up_q", "points")]
    root = lengths.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", *zero)
    nodes = cut_lineage(inner.unionByName(root).withColumn("nid", F.monotonically_increasing_id()))
    up = [F.col(a).alias(b) for a, b in (("nid", "parent"), ("p", "up_p"), ("q", "up_q"), ("conv_id", "parent_conv_id"))]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *up)
    key = ["depth", "up_p", "up_q"]
    # few parents have many children; these are told to all tasks, the others are met at their own
    large = nodes.where("depth > 0").groupBy(*key).count().where(F.col("count") > many).drop("count")
    large = bounded_side(cut_lineage(parents.join(large, key)))
    inner = nodes.where("depth > 0").join(large, key, "left")
    found = inner.where("parent is not null")
    rest = inner.where("parent is null").drop("parent", "parent_conv_id").join(parents, key)
    none = [F.lit(None).cast("long").alias(c) for c in ("parent", "parent_conv_id")]
    columns = ["nid", "parent", "depth", "p", "q", "conv_id", "parent_conv_id", "n_convs", "points"]
    every = found.select(columns).unionByName(rest.select(columns))
    return cut_lineage(every.unionByName(nodes.where("depth = 0").select(*nodes.columns, *none).select(columns)))


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(nid, after): each node's next sibling by least conversation."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, nid = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            head = first
            first = False
            if held is not None:
                parent, nid = np.append(held[0], parent), np.append(held[1], nid)
            held = parent[-1:], nid[-1:]
            after = [n if same else None for n, same in zip(nid[1:].tolist(), (parent[1:] == parent[:-1]).tolist(), strict=True)]
            yield packed(nid[:-1], after, parent[:-1], part, False)
            if head:  # its first row is told to the partition before
                yield packed(nid[:1], [None], parent[:1], part, None)
        if held is not None:
            yield packed(held[1], [None], held[0], part, True)

    def packed(nid, after, parent, part, end) -> pa.RecordBatch:
        n = len(nid)
        arrays = [pa.array(nid), pa.array(after, pa.int64()), pa.array(parent), pa.array([part] * n, pa.int32()), pa.array([end] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["nid", "after", "parent", "part", "end"])

    children = nodes.where("parent is not null").repartitionByRange("parent", "conv_id").sortWithinPartitions("parent", "conv_id")
    found = cut_lineage(children.select("parent", "nid").mapInArrow(follow, "nid long, after long, parent long, part int, end boolean"))
    # the first and last row of each partition
    heads = found.where("end is null").select("part", F.col("nid").alias("head"), F.col("parent").alias("of"))
    tails = found.where("end").select("part", "nid", "parent")
    ends = Window.orderBy("part")
    joins = heads.join(tails, "part").select("nid", "parent", F.lead("head").over(ends).alias("head"), F.lead("of").over(ends).alias("of"))
    joins = joins.select("nid", F.when(F.col("of") == F.col("parent"), F.col("head")).alias("after"))
    return found.where("end = false").select("nid", "after").unionByName(joins)


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next, leaves, saved, place) of the tour; arc 2 n enters node n and 2 n + 1 leaves it."""
    first = nodes.where("parent is not null").groupBy("parent").agg(F.min_by("nid", "conv_id").alias("child"), F.count("*").alias("n_children"))
    rows = nodes.join(first.withColumnRenamed("parent", "nid"), "nid", "left").join(next_siblings(nodes), "nid", "left")
    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    into = F.coalesce(F.col("child") * 2, leave)
    after = F.coalesce(F.col("after") * 2, F.col("parent") * 2 + 1)
    arcs = F.array(
        F.struct(enter.alias("arc"), into.alias("next"), F.col("child").isNull().cast("long").alias("leaves"),
                 ((F.col("n_convs") - 1) * F.col("points")).alias("saved")),
        F.struct(leave.alias("arc"), after.alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")),
    )
    rows = rows.select("conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.explode(arcs).alias("x"))
    return rows.select("conv_id", "n_children", "x.*")


LIST = "arc long, next long, leaves long, saved long"


def follow(arc: np.ndarray, to: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first arc outside, sums up to there) of a list's arcs, by pointer doubling; -1 is the list's end."""
    order = np.argsort(arc)
    place = np.minimum(np.searchsorted(arc, to, sorter=order), max(len(arc) - 1, 0))
    at = order[place] if len(arc) else place
    step = np.where(arc[at] == to, at, -1) if len(arc) else at
    to, values = to.copy(), [v.copy() for v in values]
    while (step >= 0).any():
        on = np.flatnonzero(step >= 0)
        by = step[on]
        added = [v[by] for v in values]
        jump, end = step[by], to[by]
        for v, more in zip(values, added, strict=True):
            v[on] += more
        step[on], to[on] = jump, end
    return to, values


def ranked(arcs: DataFrame, size: int, range_rows: int = RANGE, short: int = SHORT, keys: tuple[str, ...] = ("conv_id", "arc")) -> DataFrame:
    """(arc, leaves, saved): the sums from each arc to the end of the list. ``keys`` put arcs near those that follow them."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True)]
        if not columns:
            return
        arc, to, leaves, saved = columns
        out = ~np.isin(to, arc)
        end, (leaves, saved) = follow(arc, to, [leaves, saved])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (arc, end, leaves, saved, out)], ["arc", "next", "leaves", "saved", "out"])

    tasks = max(1, -(-size // range_rows))
    rows = arcs.withColumn("next", F.coalesce("next", F.lit(-1)))
    dealt = rows.repartitionByRange(tasks, *keys).select("arc", "next", "leaves", "saved")
    local = cut_lineage(dealt.mapInArrow(inside, LIST + ", out boolean"))
    # arcs that another range enters
    entered = local.where("out and next >= 0").select(F.col("next").alias("arc")).distinct()
    rest = cut_lineage(local.join(entered, "arc", "left_semi").select("arc", "next", "leaves", "saved"))
    sums = list_sums(rest, rest.count(), short)
    return _carried(local, sums)


def _carried(rows: DataFrame, sums: DataFrame) -> DataFrame:
    more = sums.withColumnsRenamed({"arc": "next", "leaves": "l", "saved": "s"})
    total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))]
    ended = rows.where("next < 0").select("arc", "leaves", "saved")
    return rows.where("next >= 0").join(more, "next", "left").select("arc", *total).unionByName(ended)


def list_sums(rows: DataFrame, size: int, short: int = SHORT, rulers: int = RULERS, level: int = 0) -> DataFrame:
    """(arc, leaves, saved): the sums from each arc to the end of a list of (arc, next, leaves, saved)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True)]
        if columns:
            _, (leaves, saved) = follow(columns[0], columns[1], columns[2:])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (columns[0], leaves, saved)], ["arc", "leaves", "saved"])

    if size <= short:
        return rows.coalesce(1).mapInArrow(whole, "arc long, leaves long, saved long")

    def ruler(arc: Column) -> Column:
        return F.pmod(F.xxhash64(arc, F.lit(level)), F.lit(rulers)) == 0

    # each arc's pointer jumps on until a ruler
    now = rows
    while not (open_ := now.where((F.col("next") >= 0) & ~ruler(F.col("next")))).isEmpty():
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("to"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        jumped = open_.join(ahead, "next").select("arc", F.col("to").alias("next"), (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
        now = cut_lineage(jumped.unionByName(now.where((F.col("next") < 0) | ruler(F.col("next")))))
    kept = cut_lineage(now.where(ruler(F.col("arc"))))
    sums = cut_lineage(list_sums(kept, kept.count(), short, rulers, level + 1))
    return _carried(now, sums)


def build_trie(
    conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, range_rows: int = RANGE, short: int = SHORT, many: int = MANY
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are taken by turn, null first, equal turns by role and then by the SHA-256 of role and text, and rebuilt
    as ``rebuilt_turns`` says. A null role or text is empty; a null conv_id names no conversation, its rows are
    left out. ``%`` has the sign of its left side. Repeated rows are turns of their own. A node is named by its least
    conversation and depth; the root has depth 0 and all conversations, also those without turns. saved_tokens
    sums over the subtree, its top included, the code points of a node's last text for each conversation but the first;
    ends_sha256 is of the conversations that end at the node, ascending, joined by commas. An empty table gives
    no rows. Only conv_id, turn, role and text are read, so further columns may have any name.
    """
    ship_package(conversations.sparkSession)
    turns, lengths = rebuilt_turns(conversations, block, heads)
    rows = cut_lineage(prefixes(turns))
    nodes = trie_nodes(rows, lengths, many)
    arcs = cut_lineage(tour(nodes))
    sums = ranked(arcs.select("conv_id", "arc", "next", "leaves", "saved"), arcs.count(), range_rows, short)
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    node = F.shiftright("arc", 1).alias("nid")
    inside = sums.groupBy(node).agg(
        F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens")
    )
    children = arcs.where("arc % 2 = 0").select(node, "n_children")
    name = F.concat_ws(":", "depth", "p", "q")
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "p", "q")).alias("x")).select("x.*", "conv_id").select(name.alias("key"), "conv_id")
    none = lengths.where("n_turns = 0").select(F.lit("0:0:0").alias("key"), "conv_id")
    ends = ends.unionByName(none).withColumn("value", F.col("conv_id").cast("string"))
    digests = ordered_digests(ends, ["conv_id"], ",")
    return (
        nodes.withColumn("key", name)
        .join(children, "nid")
        .join(inside, "nid")
        .join(digests, "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
