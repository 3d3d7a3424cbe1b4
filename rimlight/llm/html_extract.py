"""Main text of web pages by wrapper induction over the pages of a host.

All pages of a host are sketched and grouped by layout, the containers near the root; within a layout they are aligned in
pieces by tree matching, each page with the next. Text that stands at matched
nodes alike on pages whose other text differs belongs to the template of the layout if most of its pages, and three at
least, have it; what varies is a slot. The wrapper, the keys of the template's (path, text) pairs, is applied to every page
of its layout together with the rules that hold for any page: navigation, forms, adverts, comments and the like are no
content, and where a page marks its article, the article is the content, whole: no template cuts it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import bounded_side, cut_lineage, small_batches

# Pages that are aligned in one piece on average; text blocks that differ at least, else two pages are copies of one.
PIECE_PAGES, VARYING = 16, 2
# Pages that have a text of the template at least: what two pages share may be content.
LEAST_PAGES = 3
# Containers to this depth below the root make the layout.
LAYOUT_DEPTH = 4
CONTAINERS = set("html body div section article main aside header footer nav table form center".split())
# Wrappers go to every task up to so many keys in all; beyond that they are joined by host.
MAX_SENT_KEYS = 2_000_000
# Lists whose lengths have a larger product are aligned in linear space.
SMALL_TABLE = 4096

# Elements of HTML by how they nest and what they hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
NEVER = set(
    "nav footer aside form button select dialog menu head template object applet svg canvas audio video map".split()
)
MAIN = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay comment comments reply "
    "replies respond disqus sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar "
    "share sharing social related recommended pagination pager login widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("children", "kept", "label", "main", "no", "tag")

    def __init__(self, tag: str, label: str, no: bool):
        self.tag, self.label, self.no = tag, label, no
        self.children: list[Node | str] = []
        # main: is or holds an article; kept: is or holds the page's largest one
        self.main = self.kept = False


def _open(tag: str, attributes: str) -> Node:
    """A node with its label (tag, role and class) and whether the rules drop it."""
    found = {}
    if attributes:
        for name, *value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), unescape(next((v for v in value if v), "")).lower())
    named = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = {w for n in named for w in _PARTS.split(n) if w}
    no = (
        tag in NEVER
        or found.get("role", "") in ROLES
        or bool(words & NAMES)
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "")
    )
    # numbers in names tell pages apart, not layouts
    return Node(tag, ".".join([tag, *sorted(_DIGITS.sub("", n) for n in named)]), no and tag not in {"html", "body"})


def parse(html: str) -> Node:
    """The tree of a page. Missing end tags are supplied, unknown or open ends are text or ignored."""
    root = Node("#root", "#root", False)
    stack, at, raw = [root], 0, None
    for token in _TOKEN.finditer(html):
        begin = token.start()
        if begin < at:
            continue
        if begin > at:
            stack[-1].children.append(html[at:begin])
        at = token.end()
        end, tag, rest = token[1], token[2], token[3]
        if tag is None:
            end, tag, rest = token[4], token[5], token[6]
        if tag is None:
            if token[0].startswith("<![CDATA["):
                stack[-1].children.append(token[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
                if stack[k].tag in MAIN and tag in {"p", "div", "span"}:
                    break
            continue
        if tag in CLOSES_P:
            _end(stack, {"p"}, CLOSES_P - {"p"} | {"td", "th", "li", "body"})
        elif tag in ENDED_BY:
            _end(stack, ENDED_BY[tag], HOLDS.get(tag, set()) | {"body", *MAIN})
        node = _open(tag, rest)
        stack[-1].children.append(node)
        if tag in MAIN:
            for above in stack:
                above.main = True
            node.main = True
        if tag in RAW:
            raw = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>|\Z", re.I).search(html, at)
            at = raw.end()
        elif tag not in VOID and not rest.endswith("/") or tag in INLINE:
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    _keep_largest(root)
    return root


def _keep_largest(root: Node) -> None:
    """Mark the page's largest article, the first of equals, and what it stands in: no rule drops these.

    Its size is that of its text without what the rules drop inside, so that comments which are articles do
    not outweigh the text that they are about, nor make it larger.
    """
    if not root.main:
        return
    # page order; each node with the place of its parent
    nodes: list[tuple[Node, int]] = []
    todo = [(root, -1)]
    while todo:
        node, above = todo.pop()
        nodes.append((node, above))
        todo += [(c, len(nodes) - 1) for c in reversed(node.children) if isinstance(c, Node)]
    size = [sum(len(c.strip()) for c in node.children if isinstance(c, str)) for node, _ in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        node, above = nodes[k]
        if not node.no and node.tag not in RAW:
            size[above] += size[k]
    articles = [k for k, (node, _) in enumerate(nodes) if node.tag in MAIN]
    k = max(articles, key=lambda k: (size[k], -k))
    while k >= 0:
        nodes[k][0].kept = True
        k = nodes[k][1]


def _end(stack: list[Node], tags: set[str], barrier: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            if tags == {"p"}:
                return
            return _end(stack, tags, barrier)
        if stack[k].tag in barrier:
            return


def dropped(node: Node, inside: bool) -> bool:
    if node.tag in RAW:
        return True
    if node.kept:
        return False
    return node.no or (node.tag == "header" and not inside and not node.main)


def _hash(*parts: str) -> int:
    digest = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


@lru_cache(1 << 16)
def _step(path: int, label: str) -> int:
    """Hash of the label path from the root."""
    return _hash(str(path), label)


def blocks(root: Node) -> list[tuple[int, bool, str]]:
    """(path, in a marked article, text) of each text block that the rules leave, in page order."""
    out: list[tuple[int, bool, str]] = []
    piece: list[str] = []
    where = [0, False]

    def flush() -> None:
        text = " ".join(unescape("".join(piece)).split())
        if text:
            out.append((where[0], where[1], text))
        piece.clear()

    # an own stack: pages may nest deeper than Python calls
    todo: list[tuple] = [(root, 0, False, False)]
    while todo:
        node, path, inside, done = todo.pop()
        if isinstance(node, str):
            if not piece:
                where[:] = [path, inside]
            piece.append(node)
            continue
        if done or node.tag in ("br", "hr"):
            flush()
            continue
        if dropped(node, inside):
            if node.tag not in INLINE:
                flush()
            continue
        if node.tag not in INLINE:
            flush()
            path = _step(path, node.label)
            inside = inside or node.tag in MAIN
            todo.append((node, path, inside, True))
        todo += [(child, path, inside, False) for child in reversed(node.children)]
    flush()
    return out


def _own_text(node: Node) -> str:
    """Text of a node outside its block children."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.tag in INLINE:
            todo += reversed(child.children)
    return " ".join(unescape("".join(parts)).split())


def sketch(root: Node, texts: dict[int, tuple[int, str]] | None = None) -> np.ndarray:
    """(3, nodes) parent, label and key of each block node in page order; a key stands for (path, text), 0 for no text.

    ``texts`` is given the (path, text) of each key.
    """
    out: list[tuple[int, int, int]] = []
    todo: list[tuple[Node, int, int]] = [(root, -1, 0)]
    while todo:
        node, parent, path = todo.pop()
        if node.tag in VOID:
            continue
        if node.tag not in INLINE:
            path, text = _step(path, node.label), _own_text(node)
            key = _hash(str(path), text) if text else 0
            if text and texts is not None:
                texts[key] = path, text
            out.append((parent, _step(0, node.label), key))
            parent = len(out) - 1
        todo += [(c, parent, path) for c in reversed(node.children) if isinstance(c, Node)]
    return np.array(out, np.int64).T


def layout(root: Node) -> int:
    """Hash of the label paths of the containers near the root, without numbers and however often each is there."""
    paths, todo = set(), [(root, 0, 0)]
    while todo:
        node, path, depth = todo.pop()
        path = _step(path, _DIGITS.sub("", node.label))
        paths.add(path)
        if depth < LAYOUT_DEPTH:
            todo += [(c, path, depth + 1) for c in node.children if isinstance(c, Node) and c.tag in CONTAINERS]
    return _hash(*map(str, sorted(paths)))


class Tree:
    """A sketch with the children of each node, a hash of what each holds and of its children's labels."""

    def __init__(self, nodes: np.ndarray):
        self.parent, self.label, self.key = nodes.tolist()
        n = len(self.label)
        self.texts = n - self.key.count(0)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            self.children[self.parent[k]].append(k)
        self.whole, self.shape = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            inner = self.children[k]
            self.whole[k] = hash((self.label[k], self.key[k], *[self.whole[c] for c in inner]))
            self.shape[k] = hash((self.label[k], *[self.label[c] for c in inner]))


def _anchors(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Places of values that are once in each list, as the longest run in the order of both."""
    once = {v for v, n in Counter(x).items() if n == 1}
    at = {v: j for j, v in enumerate(y) if v in once}
    for v, n in Counter(y).items():
        if n > 1:
            at.pop(v, None)
    found = [(i, at[v]) for i, v in enumerate(x) if v in at]
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(found)
    for k, (_, j) in enumerate(found):
        place = bisect_left(ends, j)
        before[k] = last[place - 1] if place else -1
        ends[place:place + 1], last[place:place + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(found[k])
        k = before[k]
    return out[::-1]


def _aligned(lx: np.ndarray, sx: np.ndarray, ly: np.ndarray, sy: np.ndarray) -> list[tuple[int, int]]:
    """The best order-preserving match of equal labels; equal shapes count twice. Whole lists, in linear space."""
    n, m = len(lx), len(ly)
    if not n or not m:
        return []
    if n * m <= SMALL_TABLE or n == 1:
        best = np.zeros((n + 1, m + 1), np.int64)
        weight = (lx[:, None] == ly) * (1 + (sx[:, None] == sy))
        for i in range(n):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weight[i]), out=best[i + 1, 1:])
        i, j, out = n, m, []
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def last_row(lx: np.ndarray, sx: np.ndarray, ly: np.ndarray, sy: np.ndarray) -> np.ndarray:
        row = np.zeros(len(ly) + 1, np.int64)
        for label, shape in zip(lx, sx, strict=True):
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (ly == label) * (1 + (sy == shape))), out=row[1:])
        return row

    half = n // 2
    upper = last_row(lx[:half], sx[:half], ly, sy)
    lower = last_row(lx[half:][::-1], sx[half:][::-1], ly[::-1], sy[::-1])[::-1]
    cut = int(np.argmax(upper + lower))
    first = _aligned(lx[:half], sx[:half], ly[:cut], sy[:cut])
    return first + [(i + half, j + cut) for i, j in _aligned(lx[half:], sx[half:], ly[cut:], sy[cut:])]


def _siblings(a: Tree, b: Tree, x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Matched children: those that hold the same, in order, and between these the best match of labels."""
    pairs = []

    def ends(value_a: list[int], value_b: list[int], i: int, n: int, j: int, m: int) -> tuple[int, int, int, int]:
        while i < n and j < m and value_a[x[i]] == value_b[y[j]]:
            pairs.append((x[i], y[j]))
            i, j = i + 1, j + 1
        while i < n and j < m and value_a[x[n - 1]] == value_b[y[m - 1]]:
            n, m = n - 1, m - 1
            pairs.append((x[n], y[m]))
        return i, n, j, m

    i, n, j, m = ends(a.whole, b.whole, 0, len(x), 0, len(y))
    fixed = _anchors([a.whole[k] for k in x[i:n]], [b.whole[k] for k in y[j:m]]) if i < n and j < m else []
    low = i, j
    for high in [*((i + p, j + q) for p, q in fixed), (n, m)]:
        p, e, q, f = ends(a.label, b.label, low[0], high[0], low[1], high[1])
        if p < e and q < f:
            rows = [np.array([v[k] for k in part]) for part, tree in ((x[p:e], a), (y[q:f], b)) for v in (tree.label, tree.shape)]
            pairs += [(x[p + s], y[q + t]) for s, t in _aligned(*rows)]
        if high != (n, m):
            pairs.append((x[high[0]], y[high[1]]))
        low = high[0] + 1, high[1] + 1
    return pairs


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Tree matching from the root down: order-preserving pairs of nodes with equal label paths."""
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs.append((i, j))
        if a.children[i] and b.children[j]:
            todo += _siblings(a, b, a.children[i], b.children[j])
    return pairs


def alike(a: Tree, b: Tree) -> set[int] | None:
    """Keys alike at matched nodes; None if the pages do not differ: two copies of one article tell nothing of the template.

    Pages differ if each has text blocks that the other lacks in their place, however many blocks they share.
    """
    same = [a.key[i] for i, j in match(a, b) if a.key[i] and a.key[i] == b.key[j]]
    return set(same) if min(a.texts, b.texts) - len(same) >= VARYING else None


def voted(trees: list[Tree]) -> tuple[int, Counter[int]]:
    """(pages, votes): how many of the distinct pages differ from a neighbour in the list, closed to a ring, and
    on how many of them each key is alike with one of these."""
    n = len(trees)
    pages: list[set[int] | None] = [None] * n
    for k in range(n if n > 2 else n - 1):
        same = alike(trees[k], trees[(k + 1) % n])
        if same is not None:
            for place in (k, (k + 1) % n):
                pages[place] = (pages[place] or set()) | same
    found = [keys for keys in pages if keys is not None]
    return len(found), Counter(key for keys in found for key in keys)


def induce(pages: list[str]) -> list[tuple[int, str]]:
    """The template of pages of one layout: (path, text) alike at matched nodes, on most pages that differ and on three."""
    texts: dict[int, tuple[int, str]] = {}
    n, votes = voted([Tree(sketch(parse(p), texts)) for p in dict.fromkeys(pages)])
    return sorted(texts[k] for k, v in votes.items() if 2 * v > n and v >= LEAST_PAGES)


class Template:
    """The (path, text) pairs of a wrapper, known by their keys."""

    def __init__(self, keys: list[int]):
        self.keys = frozenset(keys)

    def __contains__(self, pair: tuple[int, str]) -> bool:
        return bool(self.keys) and _hash(str(pair[0]), pair[1]) in self.keys


NO_TEMPLATE = Template([])


def content(root: Node, template: set[tuple[int, str]] | Template) -> str:
    """Content blocks of a page, joined by one space: the whole marked article if there is one with text,
    else all blocks that are not of the template."""
    found = blocks(root)
    article = [text for _, inside, text in found if inside]
    return " ".join(article or [text for path, _, text in found if (path, text) not in template])


def main_text(html: str, template: set[tuple[int, str]] | Template) -> str:
    """``content`` of a page given as text."""
    return content(parse(html), template)


def sketches(pages: DataFrame) -> DataFrame:
    """(host, layout, digest, nodes) of the distinct sketches of each host; copies are one."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, nodes = [], []
            for html in batch.column(1).to_pylist():
                root = parse(html)
                layouts.append(layout(root))
                nodes.append(sketch(root).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(layouts, pa.int64()), pa.array(nodes, pa.binary())], ["host", "layout", "nodes"]
            )

    known = pages.where(F.col("host").isNotNull() & (F.length("html") > 0)).select("host", "html")
    drawn = known.mapInArrow(draw, "host string, layout long, nodes binary").withColumn("digest", F.xxhash64("nodes"))
    return drawn.dropDuplicates(["host", "layout", "digest"])


def wrappers(pages: DataFrame, piece_pages: int = PIECE_PAGES) -> DataFrame:
    """(host, wrapper): per layout the keys of its template, over all pages of each host.

    Pages that are alone with their layout are one group of their host, of layout null. A layout of several pages has an
    entry, be it empty; hosts without any key have no row.
    """

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest")
        n, votes = voted([Tree(np.frombuffer(x, np.int64).reshape(3, -1)) for x in rows.nodes])
        # the pages count under no key
        out = pd.DataFrame({"key": pd.array([None, *votes], "Int64"), "n": [n, *votes.values()]})
        return out.assign(host=key[0], layout=key[1])[["host", "layout", "key", "n"]]

    drawn = cut_lineage(sketches(pages))
    sizes = drawn.groupBy("host", "layout").count()
    sizes = sizes.withColumn("_layout", F.when(F.col("count") > 1, F.col("layout")))
    totals = sizes.groupBy(F.col("host").alias("_host"), F.col("_layout").alias("_group")).agg(F.sum("count").alias("n"))
    same = (F.col("host") == F.col("_host")) & F.col("_layout").eqNullSafe(F.col("_group"))
    groups = sizes.join(totals.where("n > 1"), same)
    groups = groups.select("host", "layout", "_layout", F.ceil(F.col("n") / piece_pages).alias("pieces"))
    parts = drawn.join(bounded_side(cut_lineage(groups)), ["host", "layout"])
    parts = parts.select("host", F.col("_layout").alias("layout"), "digest", "nodes", F.pmod("digest", "pieces").alias("piece"))
    votes = parts.groupBy("host", "layout", "piece").applyInPandas(learn, "host string, layout long, key long, n long")
    votes = cut_lineage(votes.groupBy("host", "layout", "key").agg(F.sum("n").alias("n")))
    # null layouts are the pages alone with theirs
    counted = votes.where("key is null").select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), F.col("n").alias("pages"))
    same = (F.col("host") == F.col("_host")) & F.col("layout").eqNullSafe(F.col("_layout"))
    joined = votes.join(counted, same)
    most = F.col("key").isNotNull() & (2 * F.col("n") > F.col("pages")) & (F.col("n") >= LEAST_PAGES)
    # a set leaves the null out, so each group has one
    each = joined.groupBy("host", "layout").agg(F.sort_array(F.collect_set(F.when(most, F.col("key")))).alias("keys"))
    whole = each.groupBy("host").agg(F.collect_list(F.struct("layout", "keys")).alias("wrapper"))
    return whole.where(F.exists("wrapper", lambda x: F.size(x["keys"]) > 0))


def extract_text(pages: DataFrame, piece_pages: int = PIECE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    White space inside a block is one space, blocks are joined by one. Null or empty html, and pages
    without content, give an empty text. A null url has no host and thus no wrapper; nor has a page whose layout has none. Repeated rows return
    each; only page_id, url and html are read. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("host", F.when(host != "", host))
    learned = cut_lineage(wrappers(rows, piece_pages))
    keys = F.aggregate("wrapper", F.lit(1), lambda n, x: n + F.size(x["keys"]) + 1)
    size = learned.agg(F.coalesce(F.sum(keys), F.lit(0))).first()[0]
    side = F.broadcast(learned) if size <= MAX_SENT_KEYS else learned
    # no host has a slash: pages without one are spread over the tasks
    spread = F.coalesce("host", F.concat(F.lit("/"), F.xxhash64("page_id", "html").cast("string")))
    rows = rows.withColumn("host", spread)
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", "wrapper", "host")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts: dict[str, dict[int | None, Template]] = {}
            texts = []
            for k, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if host not in hosts:
                    hosts[host] = {x["layout"]: Template(x["keys"]) for x in batch.column(3)[k].as_py() or []}
                if not html:
                    texts.append("")
                    continue
                root, templates = parse(html), hosts[host]
                own = templates.get(layout(root), templates.get(None, NO_TEMPLATE)) if templates else NO_TEMPLATE
                texts.append(content(root, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
