"""Packing documents into training windows by best-fit decreasing."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import short_batches, table, tidy
from .wordhash import slices

WINDOW = 2048
#: The vocabulary, a file name of the public tokenizers or a path that every executor has.
VOCABULARY = "word_bpe_49k.json"
#: Id that ends each document.
END_ID = 1
#: Pieces shorter than a window that are packed together; a task with more packs several such lots.
LOT = 200_000
#: Words whose ids a Python worker remembers, in about 200 bytes each, and how many the tokenizer is given at once (it
#: takes some 500 bytes for each).
REMEMBERED, LEARNT = 400_000, 8192

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Open:
    """Open windows by remaining capacity: a segment tree over capacities tells which of them have a window."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.windows: list[list[int]] = [[] for _ in range(self.half)]

    def put(self, capacity: int, which: int) -> None:
        self.windows[capacity].append(which)
        at = capacity + self.half
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest open window with at least that capacity, as (capacity, window), which it removes."""
        at = least + self.half
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.half:
            at *= 2
            if not self.count[at]:
                at += 1
        capacity = at - self.half
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For pieces of 1 to ``window`` tokens: each one's window, its offset there, and how many windows there are."""
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free, used = Open(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity, which = free.take(need) or (window, used)
        used = max(used, which + 1)
        where[i], offset[i] = which, window - capacity
        if capacity > need:
            free.put(capacity - need, which)
    return where, offset, used


class Ids:
    """Token ids of texts as bytes.

    In a text of printable ASCII and Latin-1 letters, the vocabulary's own pattern is ``piece``, and none of its pieces
    spans a blank.  So such texts are looked up, in lower case, by what stands between blanks, or else by their pieces;
    of pieces not seen lately, words of letters go to the tokenizer's model one by one, spelt as its byte-level step
    would, and the others to the tokenizer, many together; those are told apart by the ids that end a word.
    Other texts, and those in which a special token may stand, go to the tokenizer whole."""

    plain = bytes([0x0A, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    piece = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
    #: How a byte-level vocabulary writes the bytes that don't print, in their order; others are written as in Latin-1.
    unprinted = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
    #: Full stops and commas, other punctuation, the rest.
    kinds = bytes(ord("p") if c in b".," else ord("q") if 0x21 <= c < 0x7F and not chr(c).isalnum() else ord("a") for c in range(256))

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        #: ``piece`` is the pattern of this vocabulary alone.
        self.split = os.path.basename(vocabulary) == VOCABULARY
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def remember(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        cuts = (4 * ends).tolist()
        self.known.update(zip(pieces, map(ids.tobytes().__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))

    def learn(self, parts: list[str]) -> None:
        whole, mixed, split = [], [], []
        for part in parts:
            if part.isalpha():
                whole.append(part)
            else:
                mixed.append(part)
                split.append(self.piece.findall(part))
        other = []
        for piece in set().union(*split).difference(self.known, whole):
            (whole if piece.isalpha() else other).append(piece)
        found = [[token.id for token in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.unprinted))] for word in whole]
        self.remember(whole, np.array(list(chain.from_iterable(found)), dtype="<u4"), np.cumsum([len(x) for x in found], dtype=np.int64))
        ids = self.encoded(" ".join(other))
        self.remember(other, ids, np.flatnonzero(self.ends[ids]) + 1)
        look = self.known.__getitem__
        self.known.update(zip(mixed, [b"".join(map(look, y)) for y in split], strict=True))

    def parts(self, text: str) -> list[str] | None:
        """What stands between blanks in a plain text, in lower case; full stops and commas stand by themselves where
        none touches other punctuation, with which it would be one piece."""
        try:
            raw = text.encode("latin-1") if self.split else b"\0"
        except UnicodeEncodeError:
            return None
        if raw.translate(None, self.plain) or "<|" in text:
            return None
        kinds, text = raw.translate(self.kinds), text.lower().replace("\n", " ")
        if not (b"pp" in kinds or b"pq" in kinds or b"qp" in kinds):
            text = text.replace(".", " .").replace(",", " ,")
        return text.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(text) for text in texts]
        new = set().union(*filter(None, parts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {x: self.known[x] for x in set().union(*filter(None, parts)).intersection(self.known)}
        new = list(new)
        for i in range(0, len(new), LEARNT):
            self.learn(new[i : i + LEARNT])
        return [self.encoded(text).tobytes() if x is None else b"".join(itemgetter(*x)(self.known)) if len(x) > 1 else self.known[x[0]] for text, x in zip(texts, parts, strict=True)]


_ids: dict[str, Ids] = {}


def _packed(window: int, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids.get(vocabulary) or _ids.setdefault(vocabulary, Ids(vocabulary))
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        short: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def lot() -> pa.RecordBatch:
            nonlocal sequence
            where, offset, used = best_fit_decreasing(np.array([p[2] for p in short], dtype=np.int64), window)
            out = rows([(*p, sequence + w, o) for p, w, o in zip(short, where.tolist(), offset.tolist(), strict=True)])
            sequence += used
            short.clear()
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b, _, _ in slices(texts, 1 << 21):
                full = []
                for doc, found in zip(doc_ids[a:b], ids([t or "" for t in texts.slice(a, b - a).to_pylist()]), strict=True):
                    found += end
                    n = len(found) // 4
                    for start in range(0, n, window):
                        piece = found[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        row = (doc, start, length, zlib.crc32(piece), n)
                        if length == window:
                            full.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            short.append(row)
                if full:
                    yield rows(full)
                if len(short) >= LOT:
                    yield lot()
        if short:
            yield lot()

    return tidy(run)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``window`` ids; a row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``.  One longer than a window is first cut into full windows; what
    remains of it, and shorter documents, go by falling length into the open window with the least room that holds
    them.  Every partition packs its own rows in lots of 200,000 pieces, so nothing is shuffled and each leaves about
    one part-filled window; sequence ids hold the partition's number, which a task that runs again has too.

    A null or empty text is only ``end_id``.  Rows that repeat a doc_id, or have none, are documents of their own;
    pieces of equal length go in the order of the rows.  An empty table gives no row.  A long text is held whole, with
    its ids.  The strings of special tokens in a text are those tokens.  Further columns are ignored, whatever their
    names."""
    short_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_packed(window, vocabulary, end_id), _PIECES)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
