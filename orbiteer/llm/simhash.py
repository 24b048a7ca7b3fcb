"""SimHash fingerprints of documents, and a search for fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import checkpoint, short_batches, small, table, tidy

BITS = 128
#: Words of a term.
TERM = 2
#: Places of documents in the sample that limits of ranges are taken from, for each range; terms that vote together.
PER_RANGE, TERMS = 20, 8192

_KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: pa.Array, term: int = TERM) -> np.ndarray:
    """(texts, BITS) booleans.  A text's terms are its runs of ``term`` words (all words, if it has fewer); each term's
    hash votes for or against every bit with the weight 1 + ln(count), and a bit is set if the votes for it prevail."""
    out = np.zeros((len(texts), BITS), dtype=bool)
    for a, _, data, offsets in wordhash.slices(texts):
        words, first = wordhash.words(data, offsets)
        runs = wordhash.runs(words, term)
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if y > x:
                terms, count = np.unique(runs[x : y - term + 1] if y - x >= term else wordhash.runs(words[x:y], y - x), return_counts=True)
                weight, votes = (1 + np.log(count)).astype(np.float32), np.zeros(BITS, dtype=np.float64)
                for k in range(0, len(terms), TERMS):
                    own = terms[k : k + TERMS]
                    wide = np.column_stack([own, wordhash.mix(own + np.uint64(0x5851F42D4C957F2D))])
                    votes += weight[k : k + TERMS] @ np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)
                out[a + i] = 2 * votes > weight.sum(dtype=np.float64)
    return out


def _hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of two texts' weighted terms that their fingerprints' share of unequal bits stands for, at least 0."""
    return np.round(np.maximum(0.0, np.cos(np.pi * (a != b).mean(axis=1))), 6)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, bucket, extra, text) in order: a row for each that isn't extra, with the one after it."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if len(rows) > 1:
            texts = rows.column("text").combine_chunks()
            strings, bits = texts.to_pylist(), fingerprints(texts)
            bucket, extra = rows.column("bucket").to_numpy(), rows.column("extra").to_numpy()
            at = np.flatnonzero((extra[:-1] == 0) & (bucket[:-1] == bucket[1:]))
            edited = [own[: len(own) - len(own) // 4] + after[: len(own) // 4] for own, after in ((strings[i], strings[i + 1]) for i in at)]
            edited_bits = fingerprints(pa.array(edited, pa.large_string()))
            columns = [
                rows.column("doc_id").combine_chunks().take(pa.array(at)),
                pa.array([len(strings[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(_hex(bits[at]), pa.string()),
                pa.array(_hex(edited_bits), pa.string()),
                pa.array(likeness(bits[at], edited_bits)),
                pa.array(likeness(bits[at], bits[at + 1])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _KIND.split(", ")])
        held = rows.slice(len(rows) - 1)


def _count_below(cuts: list[tuple[int, int]], ord_: Column, hash_: Column) -> Column:
    """How many of the sorted ``cuts`` are at most (ord, hash), by halving."""
    ords, hashes = _longs([c[0] for c in cuts]), _longs([c[1] for c in cuts])
    zero, n = F.lit(0), F.lit(len(cuts))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        cut = F.get(ords, middle)
        above = (cut < ord_) | ((cut == ord_) & (F.get(hashes, middle) <= hash_))
        more = state["low"] < state["high"]
        return F.struct(F.when(more & above, middle + 1).otherwise(state["low"]).alias("low"), F.when(more & ~above, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, F.struct(zero.alias("low"), n.alias("high")), halve)["low"]


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Of each of ``docs`` (doc_id, text): its fingerprint, and that of its edited text, whose last quarter of code points
    is replaced by the first as many of the next document (by doc_id; after the last, the first).

    Documents are dealt once, by ranges of doc_id and, for those that repeat one, of a hash of the text.  The limits are
    places of documents, from a sample of about ``PER_RANGE`` for each range; they matter for balance only.  A range's last
    document finds the next one as a second copy of the following range's first.  A range is read in order, row by row.

    A null text is empty, and all bits of an empty text's fingerprint are 0; a long text is held whole.  A null doc_id
    comes before all others, and rows that repeat one are in order of that hash, then of their texts.  An empty table
    gives no row; of a single document, the next is itself.  Further columns are ignored, whatever their names."""
    spark = docs.sparkSession
    short_batches(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "hash")).alias("least")).first()
    least = tuple(known["least"]) if known["least"] else (0, 0)
    chance = min(1.0, PER_RANGE * ranges / max(1, known["n"]))
    picked = docs.where(F.pmod(F.xxhash64("ord", "hash", F.lit(6)), F.lit(1 << 40)) < int(chance * (1 << 40))).select("ord", "hash").distinct()
    picked = sorted(tuple(r) for r in picked.limit(4 * PER_RANGE * ranges).collect())
    cuts = sorted({picked[i * len(picked) // ranges] for i in range(1, ranges)} - {least}) if picked else []
    empty = F.array().cast("array<struct<bucket:int,extra:int>>")
    docs = docs.withColumn("own", _count_below(cuts, F.col("ord"), F.col("hash")))
    to = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("extra")))
    limit = F.col("own") - 1
    begins = (F.col("own") > 0) & (F.col("ord") == F.get(_longs([c[0] for c in cuts]), limit)) & (F.col("hash") == F.get(_longs([c[1] for c in cuts]), limit))
    to = F.concat(to, F.when(begins, F.array(F.struct(limit.alias("bucket"), F.lit(1).alias("extra")))).otherwise(empty))
    wraps = (F.col("ord") == F.lit(least[0])) & (F.col("hash") == F.lit(least[1]))
    to = F.concat(to, F.when(wraps, F.array(F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("extra")))).otherwise(empty))
    dealt = docs.select("doc_id", "ord", "hash", "text", F.explode(to).alias("to")).select("doc_id", "ord", "hash", "to.bucket", "to.extra", "text")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", "ord", "hash", "text")
    return dealt.select("doc_id", "bucket", "extra", "text").mapInArrow(tidy(_with_next), _KIND)


def fingerprint(docs: DataFrame, term: int = TERM) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of ``docs`` (doc_id, text), row by row: nulls and repeated rows as they come, a
    null or empty text with all bits 0.  An empty table gives no row; further columns are ignored."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(fingerprints(batch.column(1), term)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id long, fingerprint string")


def within_radius(queries: DataFrame, found: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """All pairs (query, fingerprint, distance) of the distinct fingerprints of ``queries`` and of ``found`` that differ
    in at most ``radius`` bits.

    With a radius below ``blocks``, two such agree in all but ``radius`` blocks of bits, so for each choice of that many blocks
    there is a table, keyed by them put first, and every pair meets in at least one of them.  With a larger one, two such differ
    in at most radius / blocks bits of some block: there is a table for each block, keyed by it, where a query looks under
    every key that is so near to its own.  Queries' keys are broadcast if they are few rows, else both sides shuffle.

    Nulls take no part, repeated fingerprints count once, empty tables give no row, further columns are ignored."""
    if radius < 0 or BITS % (4 * blocks) or radius >= blocks and BITS // blocks > 32:
        raise ValueError("blocks must cut the hexadecimal digits evenly, into numbers")
    width = BITS // 4 // blocks

    def permuted(name: str) -> Column:
        keys = [F.concat(F.lit(f"{t:x}:"), *[F.substring(name, 1 + b * width, width) for b in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return F.array(*keys)

    def near(name: str, bits: int) -> Column:
        flips = [sum(1 << i for i in chosen) for n in range(bits + 1) for chosen in combinations(range(4 * width), n)]

        def keys(b: int) -> Column:
            own = F.conv(F.substring(name, 1 + b * width, width), 16, 10).cast("long")
            return F.transform(_longs(flips), lambda x: own.bitwiseXOR(x) * blocks + b)

        return F.flatten(F.array(*map(keys, range(blocks))))

    def tables(df: DataFrame, name: str, bits: int) -> DataFrame:
        df = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return df.select(name, F.explode(permuted(name) if radius < blocks else near(name, bits)).alias("key"))

    half = BITS // 8
    distance = sum((F.bit_count(F.conv(F.substring("query", 1 + i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fingerprint", 1 + i, 8), 16, 10).cast("long"))) for i in range(0, 2 * half, 8)), F.lit(0))
    asked = small(checkpoint(tables(queries, "query", radius // blocks)))
    pairs = tables(found, "fingerprint", 0).join(asked, "key").withColumn("distance", distance.cast("int"))
    return pairs.where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


#: Of the search: words of a term, bits that two fingerprints may differ in, and blocks, of which one then differs in two.
SEARCH_TERM, SEARCH_RADIUS, SEARCH_BLOCKS = 1, 20, 8


def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near fingerprints of every document whose doc_id is divisible by 100: a row per query and near fingerprint, with
    the smallest doc_id that has it and how many have.

    Fingerprints are of single words here, which near copies share more of than runs of words: of pairs of texts whose sets
    of two-word runs have a likeness of 0.8 or more, over nine in ten are within the radius, and all that are, are found."""
    known = checkpoint(fingerprint(table(spark, sf_dir, "documents"), SEARCH_TERM))
    classes = known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    queries = known.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("query"))
    near = within_radius(queries.select(F.col("query").alias("fingerprint")), known, SEARCH_RADIUS, SEARCH_BLOCKS)
    return queries.join(near, "query").join(classes, "fingerprint").select("query_id", "doc_id", "copies", "distance")
