"""SentencePiece encoding and decoding with one forward pass over a trie of marked words.

A text, white space marked as in the model, is cut into marked words, which no piece crosses. The
distinct words of a batch are sorted, so that they form a trie in depth-first order, and the forward
state of each prefix is computed once and kept for the words that go on from it. For a unigram model
the state is the best score and its last piece (Viterbi). For a BPE model scores are merge ranks, whose
best sum is not what the model encodes; there the state is the last piece of the prefix's encoding,
and a piece may follow another only if BPE leaves the two apart, which fixes one path.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rimlight.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Encoded words and pairs of pieces that a worker holds, in bytes, with what a dictionary takes for each.
HELD_WORD_BYTES, HELD_PAIR_BYTES = 128 << 20, 48 << 20
_WORD_COST, _PAIR_COST = 150, 100
# Texts, and ids of one text, that a worker has as Python objects at a time.
PIECE_BYTES, PIECE_IDS = 1 << 20, 1 << 18
_WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
_BORDER = re.compile(f"(?<!{MARK}){MARK}").search
_UNKNOWN, _START = 1 << 20, (1 << 22) - 1
_SHORT = (2, 1)
_NONE = (0, -np.inf)


class Vocabulary:
    """Pieces with ids and scores. ``kind`` is "bpe" or "unigram"; unknown characters give bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, kind: str):
        self.pieces, self.byte_ids, self.unknown, self.kind = pieces, byte_ids, unknown, kind
        self.longest = max(map(len, pieces), default=1)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10
        self.number = {p: i for p, (i, _) in pieces.items()}
        # lengths of pieces by their last three characters, longest first; shorter ones always
        ends: dict[str, set[int]] = {}
        for piece in pieces:
            ends.setdefault(piece[-3:], set(_SHORT)).add(len(piece))
        self.endings = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        single = [c for c in "\n\t" if not any(c in p and len(p) > 1 for p in pieces)] if kind == "bpe" else []
        alone = "".join(single)
        self.split = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else _WORD).findall
        # the recent half of what is held, and the half before it, whose entries come back when met again
        self.apart: dict[int, bool] = {}
        self.older_apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.word_bytes = 0
        self.built: dict[str, list] = {}

    def marked_words(self, text: str) -> Iterator[list[str]]:
        """Marked words of a text, with the mark before its first, in lists of some ``PIECE_BYTES`` characters.

        An empty text has none. Characters that stand in no longer piece, of the line break and the tab, are
        words of their own.
        """
        marked, start = MARK + text.replace(" ", MARK) if text else "", 0
        while start < len(marked):
            border = _BORDER(marked, start + PIECE_BYTES)
            end = border.start() if border else len(marked)
            yield self.split(marked, start, end)
            start = end

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours merge first, the leftmost of equals."""
        parts, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                joined = parts[i] + parts[after[i]]
                found = self.pieces.get(joined)
                if found:
                    heapq.heappush(queue, (-found[1], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        """(score, first part, last part) after each merge that builds the piece; parts must end as one."""
        if len(piece) == 1:  # not held: any character may come
            return [(np.inf, piece, piece)]
        known = self.built.get(piece)
        if known is None:
            parts = list(piece)
            known = [(np.inf, parts[0], parts[-1])]
            while len(parts) > 1:
                scores = [self.pieces.get(x + y, _NONE)[1] for x, y in pairwise(parts)]
                best = max(scores)
                if best == -np.inf:
                    known = []
                    break
                at = scores.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                known.append((best, parts[0], parts[-1]))
            self.built[piece] = known
        return known

    def _follows(self, key: int, left: str, piece: str) -> bool:
        """Whether BPE keeps ``left`` and ``piece`` apart: no merge over their border comes first."""
        if len(self.apart) * _PAIR_COST >= HELD_PAIR_BYTES // 2:
            self.older_apart = self.apart.copy()
            self.apart.clear()
        if key in self.older_apart:
            good = self.apart[key] = self.older_apart[key]
            return good
        mine = self.history(piece)
        good = bool(mine)
        if good and left:
            theirs, i, j = self.history(left), 0, 0
            while True:
                ahead = theirs[i + 1][0] if i + 1 < len(theirs) else -np.inf
                own = mine[j + 1][0] if j + 1 < len(mine) else -np.inf
                over = self.pieces.get(theirs[i][2] + mine[j][1], _NONE)[1]
                if over == ahead == own == -np.inf:
                    break
                if over > ahead and over >= own:
                    good = False
                    break
                if ahead >= own:
                    i += 1
                else:
                    j += 1
        self.apart[key] = good
        return good

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word; sorted words share the states of their common prefixes.

        A character without a piece stands as a number above all ids.
        """
        before, size, symbol, score = "", [0], [_START], [0.0]
        pieces, endings, apart, bpe = self.number, self.endings, self.apart, self.kind == "bpe"
        for word in words:
            keep, top = 0, min(len(word), len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del size[keep + 1 :], symbol[keep + 1 :], score[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                if not bpe:
                    self._viterbi_step(word, end, size, symbol, score)
                    continue
                for n in endings.get(word[end - 3 if end > 3 else 0 : end], _SHORT):
                    if n > end:
                        continue
                    own = pieces.get(word[end - n : end])
                    if own is None:
                        if n > 1:
                            continue
                        own = _UNKNOWN + ord(word[end - 1])
                    key = symbol[end - n] << 22 | own
                    good = apart.get(key)
                    if good is None:
                        good = self._follows(key, word[end - n - size[end - n] : end - n], word[end - n : end])
                    if good:
                        break
                size.append(n)
                symbol.append(own)
            out, end = [], len(word)
            while end:
                out.append(symbol[end])
                end -= size[end]
            out.reverse()
            before = word
            yield word, out

    def _viterbi_step(self, word: str, end: int, size: list[int], symbol: list[int], score: list[float]) -> None:
        best, found, own = -np.inf, 1, 0
        for n in range(1, min(self.longest, end) + 1):
            known = self.pieces.get(word[end - n : end])
            if known is None and n > 1:
                continue
            total = score[end - n] + (known[1] if known else self.least)
            if total > best:
                best, found, own = total, n, known[0] if known else _UNKNOWN + ord(word[end - 1])
        size.append(found)
        symbol.append(own)
        score.append(best)

    def ids(self, symbols: list[int]) -> bytes:
        if symbols and max(symbols) >= _UNKNOWN:
            out: list[int] = []
            for i in symbols:
                if i < _UNKNOWN:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in chr(i - _UNKNOWN).encode()] if self.byte_ids else [self.unknown]
            symbols = out
        return array("i", symbols).tobytes()

    def hold(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.word_bytes += _WORD_COST + 2 * len(word) + len(ids)

    def learn(self, words: set[str]) -> None:
        """Hold the ids of all these words: encode those that are not held yet."""
        if self.word_bytes >= HELD_WORD_BYTES // 2:
            self.older_words, self.words, self.word_bytes = self.words, {}, 0
        new, older, hold, ids = words.difference(self.words), self.older_words, self.hold, self.ids
        again = [w for w in new if w in older]
        for word in again:
            hold(word, older[word])
        new.difference_update(again)
        runs = [w for w in new if self.kind == "bpe" and w.startswith(MARK * 2)]
        for word in runs:  # marks of equal score: by the definition itself
            hold(word, ids([self.number.get(p, _UNKNOWN + ord(p[0])) for p in self.merged(word)]))
        gc.disable()  # nothing here is cyclic, and scans of the large tables cost a fifth of the time
        try:
            for word, symbols in self.segment(sorted(new.difference(runs))):
                hold(word, ids(symbols))
        finally:
            gc.enable()

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers; null and empty texts have none. Long texts go piece by piece."""
        words = [[] if len(t or "") > PIECE_BYTES else [w for ws in self.marked_words(t or "") for w in ws] for t in texts]
        self.learn({w for ws in words for w in ws})
        held = self.words
        out = [b"".join([held[w] for w in ws]) for ws in words]
        for i, text in enumerate(texts):
            if len(text or "") > PIECE_BYTES:
                out[i] = b"".join(self._pieces(text))
        return out

    def _pieces(self, text: str) -> Iterator[bytes]:
        for words in self.marked_words(text):
            self.learn(set(words))
            held = self.words
            yield b"".join([held[w] for w in words])


@cache
def load(model: bytes, kind: str) -> tuple[Vocabulary, list[bytes]]:
    """The vocabulary of a model file's content, and the bytes each id decodes to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces, byte_ids, table = {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            table.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            table.append(b"")
        else:
            pieces[piece] = (i, sp.get_score(i))
            table.append(piece.replace(MARK, " ").encode())
    ordered = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else []
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("pieces of this model cross marked words")
    return Vocabulary(pieces, ordered, sp.unk_id(), kind), table


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of some ``PIECE_BYTES`` of text, of one row at least."""
    for batch in batches:
        places = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def _encoded(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        packed = vocabulary.packed(batch.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["doc_id", "text", "ids"]
        )


def _decoded(batches: Iterable[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    get = table.__getitem__
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("ids"))
        flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        missing = column.is_null().to_pylist()

        def text(a: int, b: int, flat: np.ndarray = flat) -> str:
            parts = [b"".join(map(get, flat[k : min(k + PIECE_IDS, b)].tolist())) for k in range(a, b, PIECE_IDS)]
            return b"".join(parts).removeprefix(b" ").decode(errors="replace")

        out = [None if missing[i] else text(int(cuts[i]), int(cuts[i + 1])) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        flat, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[cuts[i] : cuts[i + 1]]) for i in range(batch.num_rows)]
        same = [(a or "") == b for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64()), pa.array(same)],
            ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
        )


def _texts(docs: DataFrame, model: str) -> tuple[DataFrame, Broadcast[bytes]]:
    """doc_id and text of ``docs``, and the model file's content, read on the driver, for the tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(Path(model).read_bytes())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), content


def encode_documents(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, text, ids (array of int) of each whole text, without begin and end.

    The model file is read on the driver. Null and empty texts have no ids. Repeated rows return each; only
    doc_id and text are read. For models without a normalisation rule, as the default one is.
    """
    rows, content = _texts(docs, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, load(content.value, kind)[0])

    return rows.mapInArrow(encode, "doc_id long, text string, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids; null ids give null, unknown ids nothing."""
    spark = encoded.sparkSession
    content = spark.sparkContext.broadcast(Path(model).read_bytes())
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, load(content.value, kind)[1])

    return encoded.mapInArrow(decode, schema)


def coded_documents(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip.

    Texts are encoded as by ``encode_documents`` and their ids decoded as by ``decode_ids``, in one Python
    worker a task: of three in a row each comes to hold a vocabulary and its words.
    """
    rows, content = _texts(docs, model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = load(content.value, kind)
        return _digested(_decoded(_encoded(batches, vocabulary), table))

    return rows.mapInArrow(code, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
