"""Removal of lines that many pages of a host share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fits, small, table

#: A line is boilerplate if more than this share of its host's pages has it, and more than one.
RATIO = 0.05


def different_pages(pages: DataFrame) -> DataFrame:
    """One row for each different text of a host, of ``pages`` (host, text).

    Texts are compared by hash.  Only those that repeat are shuffled, one of each task."""
    keyed = pages.withColumn("key", F.xxhash64("host", F.lit("\n"), "text"))
    again = checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return pages
    once = keyed.join(small(again), "key", "left_anti")
    first = keyed.join(small(again), "key", "left_semi").groupBy("key").agg(F.min(F.struct("host", "text")).alias("page"))
    return once.select("host", "text").union(first.select("page.*"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, different: bool = True) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have any.

    A page counts once for each different line, and with ``different`` pages of a host with the same text are one page,
    so that copies of a document don't make its lines boilerplate.  Hosts and lines are counted where they are read before anything is
    shuffled, so a host with most pages, or a line on all of them, is a few rows.  A host has at most its mean number
    of lines a page, divided by ``ratio``, of them."""
    pages = docs.where("text is not null").select(F.col(host).alias("host"), "text")
    pages = different_pages(pages) if different else pages
    total = checkpoint(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = F.broadcast(total) if fits(total, F.coalesce(F.length("host"), F.lit(0)) + 16) else total
    often = counts.alias("c").join(total.alias("t"), F.expr("c.host <=> t.host and c.n > t.pages * " + repr(float(ratio)) + "D"))
    return checkpoint(often.groupBy("c.host").agg(F.collect_set("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, different: bool = True) -> DataFrame:
    """``docs`` (text, the ``host`` column and any others) without its hosts' boilerplate lines, and n_lines (before)
    and n_dropped.

    A line goes if more than ``ratio`` of its host's pages have it; one that stands on a single page isn't shared and
    stays, however few pages the host has.  Copies of a text are one page unless ``different`` is unset.

    Lines end at line feeds and are compared as they are; empty ones stay.  Lines that are left keep their order.  A
    null text stays null, with 0 lines, and isn't a page; an empty text has one empty line.  A null host is a host.  Equal
    rows get equal results, an empty table gives no row, and a long text is read whole.  A page of which all lines go
    has an empty text.  Columns of the added names, _common and _kept are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "_common", "_kept")
    common = boilerplate(docs, host, ratio, different).select(F.struct("host", "lines").alias("_common"))
    size = F.coalesce(F.length("_common.host"), F.lit(0)) + 8 * F.size("_common.lines") + 32
    common = F.broadcast(common) if fits(common, size) else common
    lines = F.split("text", "\n", -1)
    bad = F.coalesce(F.col("_common.lines"), F.array().cast("array<bigint>"))
    hits = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), bad)
    out = docs.join(common, docs[host].eqNullSafe(F.col("_common.host")), "left").withColumn("_common", hits)
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains("_common", F.xxhash64(x)))
    out = out.withColumn("_kept", F.when(F.size("_common") > 0, kept).otherwise(lines))
    columns = [F.array_join("_kept", "\n").alias(c) if c == "text" else docs[c] for c in docs.columns]
    n, left = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_kept"), F.lit(0))
    known = F.col("text").isNotNull()
    return out.select(*columns, F.when(known, n).otherwise(0).cast("long").alias("n_lines"), F.when(known, n - left).otherwise(0).cast("long").alias("n_dropped"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP7_SQL = """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
bad AS (
  SELECT l.source, list(l.line) AS lines FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source AND l.n > 1 AND l.n > t.pages * 0.05::DOUBLE GROUP BY l.source
), kept AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)), lambda x: x = '' OR NOT list_contains(coalesce(b.lines, []), x)) AS kept
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM kept
"""
