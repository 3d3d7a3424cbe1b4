"""Word hashing over the byte buffers of Arrow text columns, in numpy.

A word is a run of bytes other than ASCII white space, A-Z in lower case. Its hash is a polynomial
over the bytes modulo 2^64, taken from running sums, so that no Python object is made per word; a
finaliser spreads the bits. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=U64)

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """Words of several texts in order; text ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    hash: np.ndarray
    stem: np.ndarray | None
    last2: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def running_sums(data: np.ndarray) -> np.ndarray:
    """s with (s[e] - s[b]) * base^-b the polynomial hash of bytes b .. e."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def text_buffers(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _piece_end(data: np.ndarray, starts: np.ndarray, low: int) -> int:
    """End of a piece: a text's start, or white space, at or after a megabyte."""
    at = low + PIECE
    if at >= len(data):
        return len(data)
    k = np.searchsorted(starts, at)
    bound = int(starts[k]) if k < len(starts) else len(data)
    while at < bound:
        free = np.flatnonzero(~IS_WORD[data[at : at + PIECE]])
        if len(free):
            return min(at + int(free[0]), bound)
        at += PIECE
    return bound


def scan_words(data: np.ndarray, offsets: np.ndarray, stem: int = 0) -> Words:
    """Words of the texts in ``data``; with ``stem``, also the hash of each word's first bytes."""
    starts = np.unique(offsets[:-1])
    found, low = [], 0
    while low < len(data):
        high = _piece_end(data, starts, low)
        inner = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
        found.append(_scan(data[low:high], inner, low, stem))
        low = high
    if not found:
        none = np.zeros(0, U64)
        return Words(none, none, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    begin = np.concatenate([f[0] for f in found])
    return Words(
        np.concatenate([f[1] for f in found]),
        np.concatenate([f[2] for f in found]) if stem else None,
        np.concatenate([f[3] for f in found]),
        np.searchsorted(begin, offsets),
    )


def _scan(data: np.ndarray, starts: np.ndarray, shift: int, stem: int) -> tuple:
    word = IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[starts] = word[starts]
    last[:-1] &= ~word[1:]
    inner = starts[starts > 0] - 1
    last[inner] = word[inner]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = LOWER[data]
    sums = running_sums(low)
    last2 = low[end - 1].astype(np.int64) | (low[np.maximum(end - 2, begin)].astype(np.int64) << 8)
    heads = span_hashes(sums, begin, np.minimum(begin + stem, end)) if stem else None
    return begin + shift, span_hashes(sums, begin, end), heads, last2


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text, and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    whole = np.zeros(len(h), U64)
    step = U64(0xD6E8FEB86659FD93)
    n = max(len(h) - size + 1, 0)
    if n:
        run = h[:n].copy()
        for k in range(1, size):
            run = run * step + h[k : n + k]
        whole[:n] = mix(run)
    many = np.maximum(count - size + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(offsets[-1], U64)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], many) + np.repeat(first[:-1], many)
    out[:] = whole[place]
    for i in np.flatnonzero((count > 0) & (count < size)):
        run = U64(count[i])
        with np.errstate(over="ignore"):
            for x in h[first[i] : first[i + 1]]:
                run = run * step + x
        out[offsets[i]] = mix(np.array([run], U64))[0]
    return out, offsets
