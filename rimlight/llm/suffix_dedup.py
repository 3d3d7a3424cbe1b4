"""Repeated passages across documents: bucket-pointer refinement of sampled suffixes.

A string of ``LENGTH`` bytes is a window. Of the q-grams that lie in a window the one with the least hash, the
leftmost of equals, is the window's suffix start; equal windows choose it at the same place, so only these
suffixes, some 6 % of all, are put in order. Consecutive windows with one start are its run.

1. Initial buckets: suffixes by their q-gram. Buckets with one document are settled; a compact exchange of
   fingerprints finds them, as long as what it finds is small enough to send.
2. Refinement: a bucket is sorted by the identifier of what follows and precedes the q-gram within the run. A
   run that an earlier document has whole is removed whole. The first holder of each such sub-bucket stays in
   the game only if the identifiers of a part of it, some 40 bytes at one of three later or earlier offsets,
   agree with another holder's.
3. The sub-buckets that are left are refined once more, by the identifiers of their single windows, each of
   which is removed if a document with a smaller id has it.

Identifiers are 64-bit hashes of bytes taken from running sums, always compared within their bucket, so that a
refined identifier costs the same at any offset and none is stored. What is found goes back by content: a
document looks its runs up in the list of those that were found for it, as a run's fate depends on its bytes and
the document's id alone. Whole copies of a text are settled by their digest first.

Within a task only the least document of a run is sent to its bucket, the others are known to be repeated; a
q-gram with many different runs is dealt by run, and all of these are compared by single windows, dealt by
window. So no bucket grows with a group of copies or a frequent passage, but by one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import MAX_BROADCAST_ROWS, bounded_side, cut_lineage, small_batches
from rimlight.llm.text import PIECE, U64, mix, running_sums, span_hashes, text_buffers

LENGTH, GRAM = 50, 16
# Fingerprints sent to the tasks, 4 bytes each; beyond that all suffixes go to their buckets.
MAX_SENT = 8_000_000
# Entries of the lists sent beside documents, 8 bytes each.
MAX_LIST = 4_000_000
# Fingerprints of one part, and rows of buckets that are refined at once; a bucket with more is hot.
PART, CHUNK = 500_000, 200_000
# Different runs of one q-gram in a batch that make it hot.
HOT = 32
SALTS = 64
NO_ID = (1 << 63) - 1
MARK, KNOWN = -1, -2
WHOLE = -1
FLAGGED, OPEN, OPEN_HOT = 0, 1, 2


def _changed(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def least_starts(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring keys."""
    span, least = 1, keys
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (width - span)], least[width - span :]) if span < width else least


class Runs:
    """Runs of windows in some bytes: text, start of the q-gram, first and last window, identifier, q-gram."""

    def __init__(self, text, start, first, last, key, gram, sums, shift):
        self.text, self.start, self.first, self.last = text, start, first, last
        self.key, self.gram, self.sums, self.shift = key, gram, sums, shift

    def parts(self, length: int, gram: int) -> np.ndarray:
        """Three 21-bit identifiers in one number: of the bytes that all windows of a third of the offsets share,
        0 where the run has none of them."""
        slack = length - gram
        third = slack // 3
        nearest, farthest = self.start - self.last, self.start - self.first
        out = np.zeros(len(self.start), U64)
        for k, (low, high) in enumerate(((0, third), (third + 1, 2 * third), (2 * third + 1, slack))):
            has = (nearest <= high) & (farthest >= low)
            begin = np.where(has, self.start - low, 0)
            end = np.where(has, self.start + gram + slack - high, 1)
            value = span_hashes(self.sums, begin, end) >> U64(43)
            out |= np.where(has, np.maximum(value, U64(1)), U64(0)) << U64(21 * k)
        return out.view(np.int64)

    def windows(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, number in it, identifier) of each window of some runs."""
        count = self.last[which] - self.first[which] + 1
        run = np.repeat(which, count)
        number = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        begin = self.first[run] + number
        return run, number, span_hashes(self.sums, begin, begin + length)


def runs_of(column: pa.Array, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, Runs]]:
    """(first row, bytes, their runs) of pieces of the rows' texts; cuts depend on a text alone."""
    for low, data, at in text_buffers(column):
        at = np.asarray(at)
        ends = np.ones(len(data), bool)
        short = (at[1:, None] - np.arange(1, length)).ravel()
        ends[short[short >= 0]] = False
        # texts of a piece together; a longer one in pieces of windows
        for begin in range(0, max(len(data), 1), PIECE if len(at) == 2 else max(len(data), 1)):
            stop = min(begin + PIECE, len(data)) if len(at) == 2 else len(data)
            piece = data[max(begin - length, 0) : stop + 2 * length]
            shift = max(begin - length, 0)
            n = len(piece)
            sums = running_sums(piece)
            if n < length:
                continue
            place = np.arange(n - gram + 1)
            hashes = span_hashes(sums, place, place + gram)
            keys = (hashes >> U64(32) << U64(32)) | place.astype(U64)
            least = least_starts(keys, length - gram + 1)
            usable = ends[shift : shift + len(least)].copy()
            usable[: begin - shift] = False
            usable[stop - shift :] = False
            window = np.flatnonzero(usable)
            if not len(window):
                continue
            start = (least[window] & U64(0xFFFFFFFF)).astype(np.int64)
            head = np.flatnonzero(_changed(start))
            first, last, start = window[head], window[np.append(head[1:], len(window)) - 1], start[head]
            text = np.searchsorted(at, first + shift, "right") - 1
            key = mix(span_hashes(sums, first, last + length) + (start - first).astype(U64))
            yield low, at, Runs(text, start, first, last, key, hashes[start], sums, shift)


def _ids(batch: pa.RecordBatch, low: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(at) - 1
    return tuple(batch.column(k).slice(low, n).to_numpy(zero_copy_only=False) for k in (0, 1))


def repeated_grams(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(part, found): fingerprints of q-grams in at least two documents, sorted; a part has those of some leading bits.

    A batch sends each fingerprint once, or twice if two of its documents have it."""
    bits = parts.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
            part = (every >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
            marks = np.searchsorted(part, np.arange(parts + 1))
            prints = (every >> U64(32 - bits)).astype(np.uint32)
            some = np.flatnonzero(np.diff(marks))
            blocks = [prints[marks[p] : marks[p + 1]].tobytes() for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "found"])

        for batch in batches:
            grams, owners = [], []
            for low, _, runs in runs_of(batch.column(2), length, gram):
                grams.append(runs.gram)
                owners.append(runs.text + low)
            if not grams:
                continue
            g, d = np.concatenate(grams), np.concatenate(owners)
            order = np.lexsort((d, g))
            g, d = g[order], d[order]
            new = _changed(g)
            again = np.unique(g[~new & _changed(d)])  # also in a second document
            held += [g[new], again]
            size += int(new.sum()) + len(again)
            if size > CHUNK * 10:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part = -1

        def found() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["part", "found"])

        for batch in batches:
            for p, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield found()
                    held = []
                part = p
                held.append(np.frombuffer(block, np.uint32))
        if held:
            yield found()

    sent = docs.mapInArrow(send, "part int, found binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "part int, found binary")


def bucket_rows(docs: DataFrame, shipped, parts: int, length: int, gram: int, hot: int) -> DataFrame:
    """(gram, salt, run, parts, d, tag): one row for each run that a batch's least document has; see the module's text.

    ``shipped`` holds the fingerprints of q-grams in several documents, or None."""
    bits = parts.bit_length() - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None
        if shipped is not None:
            blocks = [np.frombuffer(b, np.uint32).astype(U64) | (U64(p) << U64(32)) for p, b in shipped.value]
            shared = np.concatenate([*blocks, np.zeros(0, U64)])
        for batch in batches:
            held = []
            for low, at, runs in runs_of(batch.column(2), length, gram):
                ids, tags = _ids(batch, low, at)
                use = slice(None)
                if shared is not None:
                    prints = runs.gram >> U64(32 - bits)
                    place = np.minimum(np.searchsorted(shared, prints), max(len(shared) - 1, 0))
                    use = shared[place] == prints if len(shared) else np.zeros(len(prints), bool)
                held.append([x[use] for x in (runs.gram, runs.key, runs.parts(length, gram), ids[runs.text], tags[runs.text])])
            if held:
                yield _combined(*(np.concatenate(x) for x in zip(*held, strict=True)), hot)

    return docs.mapInArrow(rows, "gram long, salt int, run long, parts long, d long, tag long")


def _combined(g, run, parts, d, tag, hot: int) -> pa.RecordBatch:
    """One row for each run and document; only the least document's goes to the bucket."""
    order = np.lexsort((tag, d, run, g))
    g, run, parts, d, tag = (x[order] for x in (g, run, parts, d, tag))
    bucket, new = _changed(g), _changed(g, run)
    once = _changed(g, run, d, tag)
    salt, marks, known = np.zeros(len(g), np.int32), np.zeros(0, np.int64), np.zeros(len(g), bool)
    if len(g):
        known = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        head = np.flatnonzero(bucket)
        many = np.add.reduceat(new.astype(np.int64), head) >= hot
        place = many[np.cumsum(bucket) - 1]
        salt[place] = 1 + (run[place] % U64(SALTS)).astype(np.int32)
        marks = head[many]
    # known ones need no bucket; they are dealt anywhere
    sent = np.where(known, mix(run + d.astype(U64)), g).view(np.int64)
    columns = [sent, np.where(known, 0, salt).astype(np.int32), run.view(np.int64), np.where(known, KNOWN, parts), d, tag]
    # one row tells the q-gram's own bucket that there are more
    none = np.zeros(len(marks), np.int64)
    more = [g[marks].view(np.int64), none.astype(np.int32), none, none + MARK, none + NO_ID, none]
    arrays = [pa.array(np.concatenate([c[once], m])) for c, m in zip(columns, more, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["gram", "salt", "run", "parts", "d", "tag"])


def _buckets(batches: Iterator[pa.RecordBatch], keys: int, chunk: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """(columns, continued, cut) of rows sorted by the first ``keys`` columns: whole buckets, or a part of one that has
    more than ``chunk`` rows; ``continued`` and ``cut`` tell whether it has rows before and after."""
    held: list[list[np.ndarray]] = []
    size, continued = 0, False
    for batch in batches:
        held.append([np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < chunk:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.flatnonzero(_changed(*columns[:keys]))[-1])
        if cut:
            yield [c[:cut] for c in columns], continued, False
            held, size, continued = [[c[cut:] for c in columns]], size - cut, False
        else:
            yield columns, continued, True
            held, size, continued = [], 0, True
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)], continued, False


def _several(bucket: np.ndarray, value: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether rows of two documents have a row's bucket and value."""
    order = np.lexsort((d, value, bucket))
    owner, new = d[order], _changed(bucket[order], value[order])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(order)) - 1
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = (owner[last] > owner[head])[np.cumsum(new) - 1]
    return out


def refined(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(d, tag, run, kind) of the rows' buckets: runs that an earlier document has whole, and those still open."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # run and least document at the end of a bucket's part
        for (g, salt, run, parts, d, tag), continued, cut in _buckets(batches, 2, chunk):
            bucket = np.cumsum(_changed(g, salt)) - 1
            new = _changed(bucket, run)
            least = d[new]
            if continued and before[0] == run[0]:
                least[0] = min(least[0], before[1])
            before = run[-1], least[-1]
            least = least[np.cumsum(new) - 1]
            marked = np.zeros(bucket[-1] + 1, bool)
            marked[bucket[parts == MARK]] = True
            marked[0] |= continued or cut
            hot = marked[bucket] | (salt > 0)
            flagged = (parts == KNOWN) | ((parts >= 0) & (d > least))
            held = np.flatnonzero((parts >= 0) & ~flagged)
            open_ = np.zeros(len(held), bool)
            for k in range(3):
                value = (parts[held] >> (21 * k)) & ((1 << 21) - 1)
                open_ |= (value > 0) & _several(bucket[held], value, d[held])
            lively = hot[held]
            for which, kind in ((np.flatnonzero(flagged), FLAGGED), (held[open_ & ~lively], OPEN), (held[lively], OPEN_HOT)):
                kinds = pa.array(np.full(len(which), kind, np.int8))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[which]) for x in (d, tag, run)), kinds], ["d", "tag", "run", "kind"])

    dealt = rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "run", "d")
    return dealt.mapInArrow(refine, "d long, tag long, run long, kind byte")


def _find(runs: Runs, wanted: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in ``wanted``) of runs whose key is wanted by their text; ``owner`` is the text of each."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one number for text and key; a chance hit is told by comparing both
    name = mix(wanted + mix(owner.astype(U64)))
    by = np.argsort(name)
    mine = mix(runs.key + mix(runs.text.astype(U64)))
    at = by[np.minimum(np.searchsorted(name, mine, sorter=by), len(by) - 1)]
    hit = (wanted[at] == runs.key) & (owner[at] == runs.text)
    return np.flatnonzero(hit), at[hit]


def _lists(column: pa.ListArray, low: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owner and fields of the list entries of some rows."""
    part = column.slice(low, n)
    count = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    fields = flat.flatten() if pa.types.is_struct(flat.type) else [flat]
    return np.repeat(np.arange(n), count), [f.to_numpy(zero_copy_only=False) for f in fields]


def window_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, d, tag, run, number, mask, ids) of the documents' open runs: the identifiers of their windows by q-gram, or
    for hot ones each window by itself. Rows with a mask are settled: another document of the batch has the window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, at, runs in runs_of(batch.column(2), length, gram):
                ids, tags = _ids(batch, low, at)
                owner, (wanted, hot) = _lists(batch.column(3), low, len(at) - 1)
                which, entry = _find(runs, wanted.view(U64), owner)
                # a run that its text repeats is sent once
                order = np.lexsort((runs.key[which], runs.text[which]))
                order = order[_changed(runs.text[which][order], runs.key[which][order])]
                which, lively = which[order], hot[entry[order]].astype(bool)
                yield from _cold_windows(runs, which[~lively], ids, tags, length)
                yield from _hot_windows(runs, which[lively], ids, tags, length)

    return docs.mapInArrow(rows, WINDOWS)


WINDOWS = "k long, d long, tag long, run long, number int, mask long, ids binary"


def _window_batch(k, d, tag, run, number, mask, ids) -> pa.RecordBatch:
    arrays = [pa.array(k.view(np.int64)), pa.array(d), pa.array(tag), pa.array(run.view(np.int64)),
              pa.array(number.astype(np.int32)), pa.array(mask.astype(np.int64)), ids]
    return pa.RecordBatch.from_arrays(arrays, ["k", "d", "tag", "run", "number", "mask", "ids"])


def _binary(values: np.ndarray, marks: np.ndarray) -> pa.Array:
    at = (marks * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _cold_windows(runs: Runs, which, ids, tags, length: int) -> Iterator[pa.RecordBatch]:
    if len(which):
        _, _, names = runs.windows(which, length)
        marks = np.append(0, np.cumsum(runs.last[which] - runs.first[which] + 1))
        text, none = runs.text[which], np.zeros(len(which), np.int64)
        yield _window_batch(runs.gram[which], ids[text], tags[text], runs.key[which], none, none, _binary(names, marks))


def _hot_windows(runs: Runs, which, ids, tags, length: int) -> Iterator[pa.RecordBatch]:
    if len(which):
        run, number, names = runs.windows(which, length)
        text, grams = runs.text[run], runs.gram[run]
        d = ids[text]
        order = np.lexsort((d, grams, names))
        new = _changed(names[order], grams[order])
        known = np.zeros(len(order), bool)
        known[order] = d[order] > d[order][new][np.cumsum(new) - 1]
        k = np.where(known, mix(runs.key[run] + d.astype(U64) + number.astype(U64)), names)
        mask = np.where(known, np.int64(1) << number, 0)
        yield _window_batch(k, d, tags[text], runs.key[run], number, mask, _binary(grams, np.arange(len(run) + 1)))


def repeated_windows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(d, tag, run, mask): the windows of each row that a document with a smaller id has, as bits."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(0, U64), np.zeros(0, np.int64)  # identifiers and least documents of a bucket's part
        for (k, d, tag, run, number, mask, ids), continued, cut in _buckets(batches, 1, chunk):
            count = np.fromiter((len(x) >> 3 for x in ids), np.int64, len(ids))
            names = np.frombuffer(b"".join(ids), U64)
            row = np.repeat(np.arange(len(ids)), count)
            bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + number[row]
            bucket, owner = k[row], d[row]
            if continued:
                bucket = np.concatenate([np.full(len(before[0]), k[0]), bucket])
                names, owner = np.concatenate([before[0], names]), np.concatenate([before[1], owner])
                row, bit = (np.concatenate([np.zeros(len(before[0]), np.int64), x]) for x in (row, bit))
            order = np.lexsort((owner, names, bucket))
            new = _changed(bucket[order], names[order])
            least = owner[order][new]
            if cut:
                before = names[order][new], least
            again = order[owner[order] > least[np.cumsum(new) - 1]]
            found = mask.copy()
            np.bitwise_or.at(found, row[again], np.int64(1) << bit[again])
            hit = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (d, tag, run, found)], ["d", "tag", "run", "mask"])

    dealt = rows.repartition("k").sortWithinPartitions("k", "d")
    return dealt.mapInArrow(refine, "d long, tag long, run long, mask long")


def kept_parts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text, spans, kept) of (doc_id, tag, text, list), the list being of runs with what to remove as bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b or b"" for b in batch.column(2).cast(pa.large_binary()).to_pylist()]
            begins: list[list] = [[] for _ in texts]
            ends: list[list] = [[] for _ in texts]
            for low, at, runs in runs_of(batch.column(2), length, gram):
                for text, first, last in _removed(runs, *_lists(batch.column(3), low, len(at) - 1), length):
                    shift = runs.shift - at[text]
                    order = np.argsort(text, kind="stable")
                    marks = np.flatnonzero(_changed(text[order])) if len(text) else order
                    for piece in np.split(order, marks[1:]) if len(text) else ():
                        begins[low + text[piece[0]]].append((first + shift)[piece])
                        ends[low + text[piece[0]]].append((last + shift)[piece] + length)
            spans, kept = [], []
            for text, b, e in zip(texts, begins, ends, strict=True):
                merged = _merged(b, e)
                spans.append(merged)
                parts, at = [], 0
                for first, end in merged:
                    parts.append(text[at:first])
                    at = end
                kept.append(b"".join([*parts, text[at:]]))
            found = [[{"begin": first, "end": end} for first, end in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, SPANS), pa.array(kept, pa.binary())],
                ["doc_id", "text", "spans", "kept"],
            )

    return docs.mapInArrow(cut, f"doc_id long, text string, spans {SPANS_SQL}, kept binary")


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<begin:long,end:long>>"


def _removed(runs: Runs, owner: np.ndarray, fields: list[np.ndarray], length: int) -> Iterator[tuple]:
    """(text, first window, last window) of what to remove."""
    wanted, mask = fields
    if not len(owner):
        return
    order = np.lexsort((wanted, owner))
    owner, wanted, mask = owner[order], wanted[order].view(U64), mask[order]
    head = np.flatnonzero(_changed(owner, wanted))
    mask = np.bitwise_or.reduceat(mask, head)
    which, entry = _find(runs, wanted[head], owner[head])
    whole = mask[entry] == WHOLE
    some = which[whole]
    yield runs.text[some], runs.first[some], runs.last[some]
    some, bits = which[~whole], np.zeros(len(runs.text), np.int64)
    bits[some] = mask[entry[~whole]]
    run, number, _ = runs.windows(some, length)
    on = (bits[run] >> number) & 1 == 1
    place = (runs.first[run] + number)[on]
    yield runs.text[run[on]], place, place


def _merged(begins: list[np.ndarray], ends: list[np.ndarray]) -> list[tuple[int, int]]:
    """Maximal runs of bytes of some intervals."""
    if not begins:
        return []
    b, e = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    head = np.flatnonzero(np.append(True, b[1:] > e[:-1]))
    return list(zip(b[head].tolist(), e[np.append(head[1:], len(b)) - 1].tolist(), strict=True))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_sent: int = MAX_SENT, max_list: int = MAX_LIST,
    max_ids: int = MAX_BROADCAST_ROWS, chunk: int = CHUNK, hot: int = HOT,
) -> DataFrame:
    """One row per document: doc_id, text, spans (removed byte ranges, sorted, apart), kept (the other bytes).

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id, texts being
    UTF-8 as given. A null text is empty. A null doc_id is greater than all others and not smaller than another null
    one; rows that share a doc_id, null or not, do not count against each other, be they equal or not. Rows return as
    often as they come; an empty table gives no rows. Only doc_id and text are read, so further columns may have any
    name. A run of windows, ``length - gram + 1`` at most, must fit the bits of a number (63).

    ``max_sent``, ``max_list`` and ``max_ids`` bound what is sent to all tasks; beyond them all suffixes go to their
    buckets, and lists are joined. ``chunk`` rows of a bucket are refined at once, ``hot`` different runs of a q-gram in a
    batch make it hot; none of them changes a result.
    """
    if not 0 < length - gram < 63:
        raise ValueError("a run of windows must fit the bits of a number")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("tag"), "text"
    )
    names = cut_lineage(rows.select("d", "tag", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")))
    # whole copies of a text of a smaller id
    least = names.where(F.col("n") >= length).groupBy("digest").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    least = bounded_side(cut_lineage(least.where("least < most").drop("most")), max_ids)
    copies = bounded_side(cut_lineage(names.join(least, "digest").where("d > least").select("d", "tag").distinct()), max_ids)
    rest = rows.join(copies, ["d", "tag"], "left_anti")
    told = rest.select("d", "tag", "text")
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 << max(int(2 * total / (length - gram) / PART), 1).bit_length() - 1
    found = cut_lineage(repeated_grams(told, parts, length, gram))
    shipped = None
    if (found.agg(F.sum(F.octet_length("found"))).first()[0] or 0) <= 4 * max_sent:
        shipped = spark.sparkContext.broadcast([tuple(r) for r in found.where("octet_length(found) > 0").orderBy("part").collect()])
    runs = cut_lineage(refined(bucket_rows(told, shipped, parts, length, gram, hot), chunk))
    still = runs.where(F.col("kind") != FLAGGED)
    lists = still.groupBy("d", "tag").agg(F.collect_list(F.struct("run", (F.col("kind") == OPEN_HOT).cast("long").alias("hot"))).alias("list"))
    lists = F.broadcast(lists) if still.count() <= max_list else lists
    windows = window_rows(told.join(lists, ["d", "tag"]).select("d", "tag", "text", "list"), length, gram)
    some = cut_lineage(repeated_windows(windows, chunk))
    gone = runs.where(F.col("kind") == FLAGGED).select("d", "tag", "run", F.lit(WHOLE).cast("long").alias("mask")).unionByName(some)
    ids = cut_lineage(gone.select("d", "tag").distinct())
    lists = gone.groupBy("d", "tag").agg(F.collect_list(F.struct("run", "mask")).alias("list"))
    if ids.count() <= max_ids:
        cut = rest.join(F.broadcast(ids), ["d", "tag"], "left_semi").join(lists, ["d", "tag"])
        whole = rest.join(F.broadcast(ids), ["d", "tag"], "left_anti")
    else:
        every = rest.join(lists, ["d", "tag"], "left")
        cut, whole = every.where("list is not null"), every.where("list is null")
    none = F.array().cast(SPANS_SQL)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length("text").cast("long").alias("end")))
    return (
        kept_parts(cut.select("doc_id", "tag", "text", "list"), length, gram)
        .unionByName(whole.select("doc_id", "text", none.alias("spans"), F.col("text").cast("binary").alias("kept")))
        .unionByName(
            rows.join(copies, ["d", "tag"], "left_semi").select("doc_id", "text", all_.alias("spans"), F.lit(b"").alias("kept"))
        )
    )


def repeat_report(docs: DataFrame, **options: int) -> DataFrame:
    """``without_repeats`` as figures: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return without_repeats(docs, **options).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
