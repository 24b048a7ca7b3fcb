"""Removal of long passages that an earlier document has too, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import checkpoint, short_batches, small, table, tidy

WINDOW = 50
#: Anchors start at positions that are, modulo the period, in the cover.  Fixed values: a perfect difference set, so
#: any two positions reach the cover together within a period.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Rows that a task gathers before it merges those of equal hash and sends them out.
LOT = 600_000

_ROWS = "key long, doc_id long, tag int, start int, stop int, known boolean"
_NAMES = ["key", "doc_id", "tag", "start", "stop", "known"]
_SPANS = "doc_id long, tag int, start int, stop int"


def difference_cover(period: int) -> tuple[int, ...]:
    """Residues such that every difference modulo ``period`` is one of two of them; about twice its square root."""
    if period == PERIOD:
        return COVER
    step = int(np.ceil(np.sqrt(period)))
    return tuple(sorted({*range(step), *(x % period for x in range(0, period + step, step))}))


def _batch(key, doc, tag, start, stop, known) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip((key, doc, tag, start, stop), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(known, pa.bool_())], names=_NAMES)


def _joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Spans of one length, with those of a document that overlap or are at most ``gap`` apart made one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > stop[:-1] + gap)
    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(new)])
    return doc[first], tag[first], start[first], stop[last]


class _Lots:
    """Gathers (hash, document, span) rows and merges those of equal hash before they are shuffled.  ``later``: what
    counts is that a smaller doc_id has the hash; else, that another has it.  ``gap``: how far apart spans may be joined.  What is certain within the lot is sent
    as known, dealt by document; of the rest goes what other tasks must see, at most the rows of one document a hash."""

    def __init__(self, later: bool, gap: int = 0):
        self.later, self.gap, self.rows, self.n = later, gap, [], 0

    def add(self, *row: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.n += len(row[0])
        if self.n >= LOT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, doc, tag, start, stop = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows, self.n = [], 0
        order = np.lexsort((start, doc, key))
        key, doc, tag, start, stop = key[order], doc[order], tag[order], start[order], stop[order]
        first, of = _groups(key)
        least, most = doc[first], doc[np.append(first[1:], len(key)) - 1]
        if self.later:
            sure = doc > least[of]
        else:
            both = least != most
            sure = both[of]
            n = int(both.sum())
            if n:
                zero = np.zeros(n, dtype=np.int32)
                yield _batch(key[first][both], least[both], zero, zero, zero, np.zeros(n, dtype=bool))
        # a text that repeats a few words has the same hash at place after place: one row
        rest = np.flatnonzero(~sure)
        k, d, g, a, b = key[rest], doc[rest], tag[rest], start[rest], stop[rest]
        new = np.ones(len(rest), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (a[1:] > b[:-1] + self.gap)
        first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(new)])
        yield _batch(k[first], d[first], g[first], a[first], b[last], np.zeros(len(first), dtype=bool))
        if sure.any():
            spans = _joined(doc[sure], tag[sure], start[sure], stop[sure], self.gap)
            yield _batch(wordhash.mix(spans[0].astype(np.uint64)).view(np.int64), *spans, np.ones(len(spans[0]), dtype=bool))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: where each value starts, and the number of each entry's value."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _anchors(window: int, period: int):
    length = window - period + 1
    cover = np.zeros(period, dtype=bool)
    cover[list(difference_cover(period))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = _Lots(later=False)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in wordhash.slices(batch.column(1)):
                words, first = wordhash.words(data, offsets)
                hashes = wordhash.runs(words, length)
                count = np.diff(first)
                at = np.arange(len(words)) - np.repeat(first[:-1], count)
                use = cover[at % period] & (at + length <= np.repeat(count, count)) & (np.repeat(count, count) >= window)
                use = np.flatnonzero(use[: len(hashes)])
                pos = at[use].astype(np.int32)
                doc = np.repeat(docs[a:b], count)[use]
                yield from lots.add(hashes[use].view(np.int64), doc, np.zeros(len(use), dtype=np.int32), pos - np.int32(window - length), pos + np.int32(1))
        yield from lots.flush()

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # windows that start within a window of each other cover all words between them
        lots = _Lots(later=True, gap=window - 1)
        for batch in batches:
            docs, tags, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b, data, offsets in wordhash.slices(batch.column(2)):
                words, first = wordhash.words(data, offsets)
                hashes = wordhash.runs(words, window)
                for i in range(a, b):
                    begin, n = first[i - a], first[i - a + 1] - first[i - a] - window + 1
                    if n > 0:
                        starts = np.flatnonzero(_covered(spans[i].values.to_numpy().reshape(-1, 2), n)).astype(np.int32)
                        same = np.full(len(starts), docs[i]), np.full(len(starts), tags[i])
                        yield from lots.add(hashes[begin + starts].view(np.int64), *same, starts, starts + np.int32(1))
        yield from lots.flush()

    return run


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a span (start, stop)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.clip(spans[:, 0], 0, n), 1)
    np.add.at(change, np.clip(spans[:, 1], 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def _merge(later: bool):
    """Of rows sorted by key and doc_id: the spans whose hash another (``later``: a smaller) document has."""

    def certain(rows: pa.Table) -> pa.RecordBatch:
        key, doc, start, stop = (rows.column(n).to_numpy() for n in ("key", "doc_id", "start", "stop"))
        first, of = _groups(key)
        least, most = doc[first], doc[np.append(first[1:], len(key)) - 1]
        if later:
            take = doc > least[of]
        else:
            take = ((least != most) | np.logical_or.reduceat(start == stop, first))[of] & (start < stop)
        return rows.select(_NAMES[1:5]).filter(pa.array(take)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            known = rows.column("known")
            yield from rows.filter(known).select(_NAMES[1:5]).combine_chunks().to_batches()
            rows = rows.filter(pc.invert(known))
            held = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if held.num_rows:
                keys = held.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from certain(held.slice(0, cut)).to_batches()
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from certain(held).to_batches()

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas = [], []
        # one text at a time: the words of a whole batch take ten times its bytes
        for text in batch.column(2):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "tag", "n_words", "sha"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for tag, text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (text or "").encode().split()
                spans = spans.values.to_numpy().reshape(-1, 3)
                spans = spans[spans[:, 0] == tag][:, 1:] + np.array([0, window - 1])
                gone = _covered(spans, len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(compress(words, ~gone)))
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "n_removed", "kept"])

    return run


def _flagged(rows: DataFrame, later: bool) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(tidy(_merge(later)), _SPANS)


def repeated_spans(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """The documents that share an anchor (doc_id, tag, text), dealt by doc_id, and their repeated window starts
    (doc_id, tag, start, stop): from ``start`` to before ``stop``.

    A run of ``window`` words in two documents has, within a ``period`` of its start, a place where both documents'
    positions are in the cover, so both have an anchor of ``window`` - ``period`` + 1 words there.  Hashes of anchors
    tell which windows may repeat; these alone are hashed whole, and the smallest doc_id of each hash keeps it."""
    short_batches(docs.sparkSession)
    keyed = docs.where("doc_id is not null")
    anchors = keyed.select("doc_id", "text").mapInArrow(tidy(_anchors(window, period)), _ROWS)
    spans = _flagged(anchors, later=False).groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("spans"))
    spans = checkpoint(spans)
    shared = keyed.join(small(spans.select("doc_id")), "doc_id", "left_semi").repartition("doc_id")
    windows = shared.join(spans, "doc_id").select("doc_id", "tag", "text", "spans").mapInArrow(tidy(_windows(window)), _ROWS)
    return shared, _flagged(windows, later=True)


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Removes each word of ``docs`` (doc_id, text) that lies in a run of ``window`` words which also starts in a
    document with a smaller doc_id, judged on the texts as given.  Returns a row for each document that loses words:
    doc_id, tag (a hash of its text), n_removed, kept (its other words, joined by blanks).

    Words are as in ``common.WORD``, unchanged.  A null or empty text has none.  A null doc_id takes no part.  Rows that repeat
    a doc_id are the same document: they don't remove each other's words; those with the same text, too, give a row each.
    A text of any length is read whole: its hashes take 16 bytes a word.  Of documents with the same words the smallest doc_id
    keeps them, so there are no ties.  An empty table gives no row.  Further columns are ignored, whatever their names."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    shared, spans = repeated_spans(docs, window, period)
    lists = spans.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("tag", "start", "stop"))).alias("spans"))
    cut = shared.join(lists, "doc_id").select("doc_id", "tag", "text", "spans").mapInArrow(_cut(window), "doc_id long, tag int, n_removed long, kept string")
    return cut.where("n_removed > 0")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    whole = docs.mapInArrow(tidy(_whole), "doc_id long, tag int, n_words long, sha string")
    cut = remove_repeats(docs).select("doc_id", "tag", "n_removed", F.sha2("kept", 256).alias("kept_sha")).distinct()
    found = whole.join(cut, ["doc_id", "tag"], "left")
    return found.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
