"""Class-based n-gram language model: exchange clustering over corpus counts, smoothed scores.

Words are known by a 64-bit hash. The most frequent words are units of their own, the core; all others are one
unit meanwhile. Exchange clustering moves core units between classes while the mutual information of
neighbouring classes grows, on bigram counts of the whole training corpus, which stay in Spark: a step brings back
the best classes of some units and the totals of classes. Each other training word then goes to the
class where its own counts of classes before and after it add most. Core and classes grow with the
vocabulary. The probability of a word is that of its class after the class before, times that of the word within its class:

    P(w | v) = P(C(w) | C(v)) (c(w) + 1) / (N_C + V_C + 1)

with one place in each class for words not seen; such a word has the class of most words seen once with its last
two bytes. Counts and classes of words outside the frequent ones are joined, not sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import crc_fold, cut_lineage, small_batches
from rimlight.llm.text import U64, Words, mix, scan_words, text_buffers

# At least so many; both grow with the cube root of the vocabulary.
UNITS_WORDS, CLASSES, SWEEPS = 768, 48, 2
# Parts of the core that move one after another in a sweep, share of moved units that ends the sweeps, tasks of a step.
PARTS, SETTLED, TASKS = 16, 0.02, 4
UNITS_GROW, CLASSES_GROW = 12, 1
ENDINGS = 1 << 16
CELLS, FEW = 4_000_000, 8
SENT_WORDS = 65_536
FOLDS, HELD = 7, 2
FLUSH = 400_000
# the end of a text is a token; its hash is that of no word for all practical purposes
END = int(mix(np.array([0x454E44], U64))[0])


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, last2, text) of all tokens: each text's words, then its end."""
    n = len(words.first) - 1
    count = np.diff(words.first)
    text = np.repeat(np.arange(n), count + 1)
    place = np.cumsum(count + 1) - 1
    hashes = np.full(len(text), END, U64)
    ends = np.zeros(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[place] = False
    hashes[inner], ends[inner] = words.hash, words.last2
    return hashes, ends, text


def _summed(held: list[tuple], keys: int) -> tuple:
    """The columns of ``held`` with the last one summed by the first ``keys`` columns; sorted by these."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.lexsort(columns[:keys][::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
    begin = np.flatnonzero(new)
    number = np.add.reduceat(columns[-1], begin) if len(begin) else columns[-1]
    return *(c[begin] for c in columns[:-1]), number


def _flushed(pieces: Iterator[tuple], keys: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces within a task, given on where they grow beyond ``FLUSH``."""

    def batch_of(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in x], names)

    held: list[tuple] = []
    for piece in pieces:
        held.append(piece)
        if sum(len(x[0]) for x in held) > FLUSH:
            held = [_summed(held, keys)]
            if 2 * len(held[0][0]) > FLUSH:
                yield batch_of(held[0])
                held = []
    if held:
        yield batch_of(_summed(held, keys))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, e, c): hash, last two bytes and count of each token; summed within a task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for _, data, at in text_buffers(batch.column(0)):
                    hashes, last2, _ = with_ends(scan_words(data, at))
                    distinct, first, number = np.unique(hashes, return_index=True, return_counts=True)
                    yield distinct, last2[first], number

        return _flushed(pieces(), 1, ["h", "e", "c"])

    return texts.mapInArrow(count, "h long, e long, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c"))


class Lexicon:
    """Some words: sorted hashes with counts and a number, the unit or the class."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.numbers = hashes[order], counts[order], numbers[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) of each hash."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return place, self.hashes[place] == hashes

    def number(self, hashes: np.ndarray, other: int) -> np.ndarray:
        place, known = self.find(hashes)
        return np.where(known, self.numbers[place], other)


def collected(df: DataFrame) -> list[np.ndarray]:
    """The columns of long numbers of a table of bounded size, brought over as bytes."""
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)

    rows = df.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)).collect()
    return [np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.int64) for k in range(len(names))]


SIDES = "u long, v0 binary, n0 binary, v1 binary, n1 binary"


def _side_rows(u: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each of ``u``, with the entries of both sides, which are sorted by their unit."""
    arrays = [pa.array(u)]
    for owner, other, number in sides:
        marks = np.searchsorted(owner, np.append(u, np.iinfo(np.int64).max))
        arrays += [_numbers(other.astype(np.int32), marks), _longs(number.astype(np.int64), marks)]
    return pa.RecordBatch.from_arrays(arrays, ["u", "v0", "n0", "v1", "n1"])


def neighbour_counts(texts: DataFrame, shipped, units: int) -> DataFrame:
    """(u, v0, n0, v1, n1): for each unit the units after it and before it, with counts; a text follows an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shipped.value)
        held: list[tuple] = []
        for batch in batches:
            for _, data, at in text_buffers(batch.column(0)):
                u = lexicon.number(with_ends(scan_words(data, at))[0], units - 1)
                before = np.concatenate([[0], u[:-1]])  # the end is unit 0, and stands before each text
                held.append(np.unique(before * units + u, return_counts=True))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held = [_summed(held, 1)]
                    if 2 * len(held[0][0]) > FLUSH:
                        yield packed(*held[0])
                        held = []
        if held:
            yield packed(*_summed(held, 1))

    def packed(pair: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        left, right = pair // units, pair % units
        turn = np.argsort(right, kind="stable")
        return _side_rows(np.union1d(left, right), [(left, right, number), (right[turn], left[turn], number[turn])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield whole(held)
                    held = []
                held.append(row)
        if held:
            yield whole(held)

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        u, sides = np.array([rows[0][0]]), []
        for k in (1, 3):
            other = np.frombuffer(b"".join(r[k] for r in rows), np.int32).astype(np.int64)
            number = np.frombuffer(b"".join(r[k + 1] for r in rows), np.int64)
            other, number = _summed([(other, number)], 1) if len(other) else (other, number)
            sides.append((np.full(len(other), u[0]), other, number))
        return _side_rows(u, sides)

    sent = texts.mapInArrow(count, SIDES)
    return sent.repartition("u").sortWithinPartitions("u").mapInArrow(merge, SIDES)


def context_counts(texts: DataFrame, shipped, classes: int) -> DataFrame:
    """(h, e, k, n) of words outside the core: how often class k stands before, or class k - classes - 1 after.

    Class ``classes`` is that of all words outside the core. A row has all that a task has seen of a word: k and n are
    lists of 32-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shipped.value)
        held: list[tuple] = []
        for batch in batches:
            for _, data, at in text_buffers(batch.column(0)):
                hashes, last2, _ = with_ends(scan_words(data, at))
                c = lexicon.number(hashes, classes)
                # an end, of class 0, stands before and after each text's words
                other = np.flatnonzero(c == classes)
                before, after = np.concatenate([[0], c])[other], np.concatenate([c[1:], [0]])[other]
                h, e = np.tile(hashes[other], 2), np.tile(last2[other], 2)
                k = np.concatenate([before, after + classes + 1])
                held.append(_summed([(h, k, e, np.ones(len(h), np.int64))], 2))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held = [_summed(held, 2)]
                    if 2 * len(held[0][0]) > FLUSH:
                        yield packed(*held[0])
                        held = []
        if held:
            yield packed(*_summed(held, 2))

    def packed(h: np.ndarray, k: np.ndarray, e: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
        marks = np.append(first, len(h))
        arrays = [pa.array(h[first].view(np.int64)), pa.array(e[first]), _numbers(k.astype(np.int32), marks), _numbers(n.astype(np.int32), marks)]
        return pa.RecordBatch.from_arrays(arrays, ["h", "e", "k", "n"])

    return texts.mapInArrow(count, "h long, e long, k binary, n binary")


def assigned(contexts: DataFrame, between: np.ndarray, classes: int) -> DataFrame:
    """(h, e, c, cls): each word with its count and the class where its contexts add most to the likelihood."""

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by context k, pairs of it with each class
        table = np.concatenate([between[:, :classes], between[:classes].T])
        base = h(table)
        rows, cols = between[:classes].sum(axis=1), between[:, :classes].sum(axis=0)
        # most words come a few times: what that many pairs or words add is known beforehand
        added = np.stack([h(table + n) - base for n in range(1, FEW + 1)]).astype(np.float32)
        taken = np.stack([h(rows + n) - h(rows) + h(cols + n) - h(cols) for n in range(FEW + 1)])

        def of(word: np.ndarray, k: np.ndarray, e: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            word, k, e, n = _summed([(word, k, e, n)], 2)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            gain = np.empty((len(start), classes))
            step = max(CELLS // classes, 1)
            low = 0
            while low < len(start):
                high = max(int(np.searchsorted(start, start[low] + step)), low + 1)
                a, b = start[low], start[high] if high < len(start) else len(word)
                near, times = k[a:b], n[a:b]
                more = added[np.minimum(times, FEW) - 1, near]
                many = np.flatnonzero(times > FEW)
                more[many] = h(table[near[many]] + times[many, None]) - base[near[many]]
                gain[low:high] = np.add.reduceat(more, start[low:high] - a, axis=0)
                low = high
            count = np.add.reduceat(np.where(k <= classes, n, 0), start)[:, None]
            often = np.flatnonzero(count[:, 0] > FEW)
            own = taken[np.minimum(count[:, 0], FEW)]
            own[often] = h(rows + count[often]) - h(rows) + h(cols + count[often]) - h(cols)
            gain -= own
            if classes > 1:
                gain[:, 0] = -np.inf
            arrays = [word[start], e[start], count[:, 0], np.argmax(gain, axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["h", "e", "c", "cls"])

        def entries(batch: pa.RecordBatch) -> list[np.ndarray]:
            word, e = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            lists = [c.to_pylist() for c in batch.columns[2:]]
            count = np.fromiter((len(x) >> 2 for x in lists[0]), np.int64, len(word))
            k, n = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in lists)
            return [np.repeat(word, count), k, np.repeat(e, count), n]

        # a word's rows are next to each other; its last batch may not have all of them
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = entries(batch)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield of(*(x[:cut] for x in now))
        if held is not None and len(held[0]):
            yield of(*held)

    # a task gets some ten thousand words at a time
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(best, "h long, e long, c long, cls long")


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each unit: units move, one after another, to the class with the best likelihood.

    Starts from units dealt by falling frequency. The end, unit 0, is a class of its own.
    """
    left, right = np.nonzero(counts)
    return exchange_pairs(left, right, counts[left, right], len(counts), classes, sweeps)[0]


def exchange_pairs(
    left: np.ndarray, right: np.ndarray, number: np.ndarray, n: int, classes: int, sweeps: int, rest: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """``exchange`` on the pairs that there are: (class of each unit, counts of neighbouring classes).

    With ``rest`` the last unit keeps one more class, ``classes``, for itself.
    """
    number = number.astype(float)
    size, last = classes + rest, n - rest
    volume = np.bincount(left, number, n) + np.bincount(right, number, n)
    order = [u for u in np.argsort(-volume, kind="stable") if 0 < u < last]
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(len(order)) % max(classes - 1, 1) if classes > 1 else 0
    if rest:
        cls[last] = classes
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    from_left = np.searchsorted(left[by_left], np.arange(n + 1))
    from_right = np.searchsorted(right[by_right], np.arange(n + 1))

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    between = np.bincount(cls[left] * size + cls[right], number, size * size).reshape(size, size)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a = cls[u]
            to, of = by_left[from_left[u] : from_left[u + 1]], by_right[from_right[u] : from_right[u + 1]]
            out, into = np.bincount(cls[right[to]], number[to], size), np.bincount(cls[left[of]], number[of], size)
            own = number[to][right[to] == u].sum()
            out[a] -= own
            into[a] -= own
            # take u out of its class
            between[a] -= out
            between[:, a] -= into
            between[a, a] -= own
            # wherever u goes, classes before and after it regain their pairs with it
            rows, cols = between.sum(axis=1) + into, between.sum(axis=0) + out
            base = h(between)
            gain = (h(between + out) - base).sum(axis=1) + (h(between + into[:, None]) - base).sum(axis=0)
            corner = np.diag(between)
            gain += h(corner + out + into + own) - h(corner + out) - h(corner + into) + h(corner)
            gain -= h(rows + out.sum() + own) - h(rows) + h(cols + into.sum() + own) - h(cols)
            gain[0] = -np.inf
            gain[classes:] = -np.inf
            b = int(np.argmax(gain)) if classes > 1 else a
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[u] = b
            between[b] += out
            between[:, b] += into
            between[b, b] += own
        if not moved:
            break
    return cls, between


def _likelihood(between: np.ndarray) -> float:
    """What the class of the neighbour tells: the part of the log likelihood that depends on the classes."""

    def h(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())

    return h(between) - h(between.sum(axis=0)) - h(between.sum(axis=1))


def _unit_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for u, v0, n0, v1, n1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield u, np.frombuffer(v0, np.int32), np.frombuffer(n0, np.int64), np.frombuffer(v1, np.int32), np.frombuffer(n1, np.int64)


def class_table(sides: DataFrame, cls: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring classes of units."""
    shipped = sides.sparkSession.sparkContext.broadcast(cls)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, total = shipped.value, np.zeros((size, size))
        for batch in batches:
            for u, v0, n0 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[cls[u]] += np.bincount(cls[np.frombuffer(v0, np.int32)], np.frombuffer(n0, np.int64), size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used].astype(np.int64))], ["pair", "c"])

    # a few tasks, and a number for each pair of classes from each: no shuffle is worth its tasks
    pair, c = collected(sides.select("u", "v0", "n0").mapInArrow(count, "pair long, c long"))
    return np.bincount(pair, c, size * size).reshape(size, size)


def best_moves(sides: DataFrame, cls: np.ndarray, between: np.ndarray, classes: int) -> list[np.ndarray]:
    """(unit, class, gain in millionths) of the units that another class would suit better, each alone."""
    shipped = sides.sparkSession.sparkContext.broadcast((cls, between))
    last = len(cls) - 1
    size = len(between)

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, whole = shipped.value
        found = []
        for batch in batches:
            for u, v0, n0, v1, n1 in _unit_rows(batch):
                if not 0 < u < last:
                    continue
                a = cls[u]
                out, into = np.bincount(cls[v0], n0, size), np.bincount(cls[v1], n1, size)
                own = float(n0[v0 == u].sum())
                out[a] -= own
                into[a] -= own
                between = whole.copy()
                between[a] -= out
                between[:, a] -= into
                between[a, a] -= own
                # wherever u goes, classes before and after it regain their pairs with it
                rows, cols = between.sum(axis=1) + into, between.sum(axis=0) + out
                base = h(between)
                gain = (h(between + out) - base).sum(axis=1) + (h(between + into[:, None]) - base).sum(axis=0)
                corner = np.diag(between)
                gain += h(corner + out + into + own) - h(corner + out) - h(corner + into) + h(corner)
                gain -= h(rows + out.sum() + own) - h(rows) + h(cols + into.sum() + own) - h(cols)
                gain[0] = gain[classes:] = -np.inf
                b = int(np.argmax(gain))
                if gain[b] > gain[a] + 1e-6:
                    found.append((u, b, int(1e6 * (gain[b] - gain[a]))))
        arrays = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))]
        yield pa.RecordBatch.from_arrays(arrays, ["u", "b", "gain"])

    return collected(sides.mapInArrow(best, "u long, b long, gain long"))


def exchange_sweeps(sides: DataFrame, units: int, classes: int, sweeps: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, counts of neighbouring classes, likelihood after each step), with the units' counts in Spark.

    Unit 0 is the end, a class of its own; the last unit stands for all words outside the core and keeps the class
    ``classes``. A step asks the tasks for the best class of a part of the units, each as if it moved alone, and
    moves them together; as neighbours may move at once, a step that would lower the likelihood is halved, the
    smaller gains going first, until it does not. So the likelihood never falls. Only classes and class totals come back.
    """
    size = classes + 1
    volume = np.zeros(units)
    totals = sides.select("u", (F.octet_length("v0") + F.octet_length("v1")).cast("long").alias("n"))
    u, n = collected(totals)
    volume[u] = n
    order = [u for u in np.argsort(-volume, kind="stable") if 0 < u < units - 1]
    cls = np.zeros(units, np.int64)
    cls[order] = 1 + np.arange(len(order)) % max(classes - 1, 1) if classes > 1 else 0
    cls[units - 1] = classes
    between = class_table(sides, cls, size)
    steps = [_likelihood(between)]
    for _ in range(sweeps if classes > 2 else 0):
        moved = 0
        for part in range(parts):
            u, b, gain = best_moves(sides.where(F.col("u") % parts == part), cls, between, classes)
            by = np.argsort(-gain, kind="stable")
            while len(by):
                new = cls.copy()
                new[u[by]] = b[by]
                table = class_table(sides, new, size)
                if _likelihood(table) > steps[-1]:
                    cls, between = new, table
                    steps.append(_likelihood(table))
                    moved += len(by)
                    break
                by = by[: len(by) // 2]
        if moved <= len(order) * SETTLED:
            break
    return cls, between, steps


def word_classes(
    train: DataFrame, counts: DataFrame, distinct: int, n_words: int, classes: int, sweeps: int, sent_words: int
) -> tuple[DataFrame, tuple, int]:
    """((h, e, c, cls) of each training word, (hash, count, class) of the frequent ones, number of classes).

    The end comes first among the frequent ones, also without training rows.
    """
    spark = train.sparkSession
    root = distinct ** (1 / 3)
    n_words, classes = max(n_words, round(UNITS_GROW * root)), max(classes, round(CLASSES_GROW * root))
    end = int(np.array([END], U64).view(np.int64)[0])
    hashes, ends, number = collected(counts.orderBy(F.col("h") != end, F.desc("c"), "h").limit(min(n_words, sent_words)).select("h", "e", "c"))
    order = np.lexsort((hashes, -number, hashes != end))
    hashes, ends, number = hashes[order], ends[order], number[order]
    if not len(hashes):
        return counts.withColumn("cls", F.lit(0).cast("long")), (np.array([END], U64), np.zeros(1, np.int64), np.zeros(1, np.int64)), classes
    # unit 0 is the end; the last one stands for all words outside the core
    units = len(hashes) + 1
    core = spark.sparkContext.broadcast((hashes.view(U64), number, np.arange(len(hashes))))
    sides = cut_lineage(neighbour_counts(train, core, units).coalesce(TASKS))
    cls, between, _ = exchange_sweeps(sides, units, classes, sweeps)
    own = list(zip(*(x.tolist() for x in (hashes, ends, number, cls[:-1])), strict=True))
    words = spark.createDataFrame(own, "h long, e long, c long, cls long")
    frequent = hashes.view(U64), number, cls[:-1]
    if distinct > len(hashes):
        core = spark.sparkContext.broadcast(frequent)
        others = cut_lineage(assigned(context_counts(train, core, classes), between, classes))
        words = words.unionByName(others)
        h, c, k = collected(others.orderBy(F.desc("c"), "h").limit(max(sent_words - len(hashes), 0)).select("h", "c", "cls"))
        added = h.view(U64), c, k
        frequent = tuple(np.concatenate(x) for x in zip(frequent, added, strict=True))
    return words, frequent, classes


def unseen_classes(words: DataFrame, classes: int) -> np.ndarray:
    """Class of a word not seen, by its last two bytes: that of most words seen once with them, or of most at all."""
    once = cut_lineage(words.where("c = 1 and cls > 0").groupBy("e", "cls").count())

    def most(df) -> DataFrame:
        return df.agg(F.max(F.struct("count", (-F.col("cls")).alias("cls")))["cls"].alias("cls"))

    overall = most(once.groupBy("cls").agg(F.sum("count").alias("count"))).first()[0]
    found = np.full(ENDINGS, min(1, classes - 1) if overall is None else -overall)
    for e, c in most(once.groupBy("e")).collect():
        found[e] = -c
    return found


def tagged(rows: DataFrame, words: DataFrame, frequent: tuple, unseen: np.ndarray, joins: bool) -> DataFrame:
    """(doc_id, n_tokens, n_known, gain, seq): the classes of each text's tokens as 32-bit numbers, and the sum of
    log10(c + 1) of its tokens. With ``joins`` there are training words besides the frequent ones."""
    model = rows.sparkSession.sparkContext.broadcast((frequent, unseen))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, unseen = model.value
        lexicon = Lexicon(*frequent)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, data, at in text_buffers(batch.column(1)):
                n = len(at) - 1
                tokens, last2, text = with_ends(scan_words(data, at))
                place, known = lexicon.find(tokens)
                count = np.where(known, lexicon.counts[place], 0)
                seq = np.where(known, lexicon.numbers[place], 0).astype(np.int32)
                # the others are numbered within their text, from -1 down
                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort((tokens[rare], text[rare]))]
                new = np.ones(len(rare), bool)
                new[1:] = (text[rare][1:] != text[rare][:-1]) | (tokens[rare][1:] != tokens[rare][:-1])
                first = rare[new]
                marks = np.searchsorted(text[first], np.arange(n + 1))
                seq[rare] = marks[text[rare]] - np.cumsum(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0).slice(low, n),
                        pa.array(np.bincount(text, minlength=n)),
                        pa.array(np.bincount(text, count > 0, n).astype(np.int64)),
                        pa.array(np.bincount(text, np.log10(count + 1.0), n)),
                        _numbers(seq, np.append(0, np.cumsum(np.bincount(text, minlength=n)))),
                        pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(tokens[first].view(np.int64))),
                        _numbers(unseen[last2[first]].astype(np.int32), marks),
                    ],
                    ["row", "doc_id", "n_tokens", "n_known", "gain", "seq", "h", "other"],
                )
                row += n

    schema = "row long, doc_id long, n_tokens long, n_known long, gain double, seq binary, h array<long>, other binary"
    found_type = "array<struct<i:int,c:long,cls:long>>"
    now = rows.mapInArrow(local, schema)
    if joins:
        now = cut_lineage(now)
        rare = now.select("row", F.posexplode("h").alias("i", "h"))
        found = rare.join(words.select("h", "c", "cls"), "h").groupBy("row").agg(F.collect_list(F.struct("i", "c", "cls")).alias("found"))
        now = now.drop("h").join(found, "row", "left")
    else:
        now = now.withColumn("found", F.lit(None).cast(found_type))
    now = now.select("doc_id", "n_tokens", "n_known", "gain", "seq", "other", "found")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(6)
            marks = np.append(0, np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            i, c, cls = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
            known, gain, out = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for r, (seq, other) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                seq, other = np.frombuffer(seq, np.int32).copy(), np.frombuffer(other, np.int32).copy()
                mine, count = slice(marks[r], marks[r + 1]), np.zeros(len(other), np.int64)
                other[i[mine]], count[i[mine]] = cls[mine], c[mine]
                open_ = seq < 0
                which = -1 - seq[open_]
                times = np.bincount(which, minlength=len(other))
                known[r] += int(times[count > 0].sum())
                gain[r] += float((times * np.log10(count + 1.0)).sum())
                seq[open_] = other[which]
                out.append(seq.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(known, pa.int64()), pa.array(gain, pa.float64()), pa.array(out, pa.binary())],
                ["doc_id", "n_tokens", "n_known", "gain", "seq"],
            )

    return cut_lineage(now.mapInArrow(whole, "doc_id long, n_tokens long, n_known long, gain double, seq binary"))


def _numbers(values: np.ndarray, marks: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values."""
    at = (marks * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _longs(values: np.ndarray, marks: np.ndarray) -> pa.Array:
    """Runs of 64-bit numbers as binary values."""
    return _numbers(np.ascontiguousarray(values).view(np.int32), 2 * marks)


def class_pairs(tags: DataFrame, classes: int) -> np.ndarray:
    """Counts of neighbouring classes; a text follows an end, of class 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                c = np.frombuffer(seq, np.int32).astype(np.int64)
                total += np.bincount(np.concatenate([[0], c[:-1]]) * classes + c, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "c"])

    pair, c = collected(tags.select("seq").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")))
    between = np.zeros((classes, classes))
    between.ravel()[pair] = c
    return between


def score_documents(
    docs: DataFrame, n_words: int = UNITS_WORDS, classes: int = CLASSES,
    sweeps: int = SWEEPS, sent_words: int = SENT_WORDS, folds: int = FOLDS, held: int = HELD,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words without ASCII white space, A-Z in lower case, and an end; null is an empty text,
    which has the end alone. Documents whose crc32(doc_id as text) modulo ``folds`` is ``held`` are
    scored but not learned from; a null doc_id is fold 0. Repeated rows are counted and return each.
    Without training rows, N, V and all counts are 0. Scores are log10 probabilities: base_score of the unigram
    model with one added, score of the class model. Only doc_id and text are read. ``n_words`` and
    ``classes`` are least numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    train = rows.where(crc_fold(folds) != held).select("text")
    counts = cut_lineage(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, frequent, classes = word_classes(train, counts, distinct, n_words, classes, sweeps, sent_words)
    tags = tagged(rows, words, frequent, unseen_classes(words, classes), distinct > len(frequent[0]))
    between = class_pairs(tags.where(crc_fold(folds) != held), classes)
    # class transition: Witten-Bell interpolation with the class unigram, itself with one added
    seen = (between > 0).sum(axis=1, keepdims=True)
    unigram = (between.sum(axis=0) + 1) / (between.sum() + classes)
    step = np.log10((between + np.maximum(seen, 1) * unigram) / (between.sum(axis=1, keepdims=True) + np.maximum(seen, 1)))
    # words and distinct words of each class, from all counts
    sums = words.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    size = np.bincount(sums.cls.to_numpy(np.int64), sums.n.to_numpy(float) + sums.v.to_numpy(float), classes) + 1
    model = spark.sparkContext.broadcast(step - np.log10(size)[None, :])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = model.value
        for batch in batches:
            sums = []
            for seq in batch.column(4).to_pylist():
                c = np.frombuffer(seq, np.int32)
                sums.append(float(step[np.concatenate([[0], c[:-1]]), c].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.float64())], [*names, "steps"])

    names = ["doc_id", "n_tokens", "n_known", "gain"]
    scored = tags.select(*names, "seq").mapInArrow(score, "doc_id long, n_tokens long, n_known long, gain double, steps double")
    floor = F.log10(F.lit(float(total + distinct + 1)))
    return scored.select(
        "doc_id",
        (crc_fold(folds) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("gain") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("steps") + F.col("gain")).alias("score"),
    )
