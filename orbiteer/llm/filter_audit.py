"""What each of five quality filters removes in every order, with exact duplicates found by partition refinement."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small, table

#: The filters; a document's mask has bit i if the i-th of them fails it.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Code points where the successive blocks of a text begin; the last goes on to its end.
BLOCKS = (0, 64, 512, 4096, 32768)
#: What tasks have combined of one text is combined again in so many parts before it meets.
PARTS = 16


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def failures(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with mask: the bits of the filters that need a text alone, A to D."""
    words = F.array_remove(F.split(_text(), r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(_text()) - F.length(F.regexp_replace(_text(), "[A-Z]+", ""))
    n, different = F.size("_words"), F.size(F.array_distinct("_words"))
    failed = [n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(_text()), _text().rlike(r"[#$%&*|]")]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))
    return docs.withColumn("_words", words).withColumn("mask", mask).drop("_words")


def _hashes(hashed: Callable[..., Column]) -> list[Column]:
    """The number of code points and a hash of each successive block, null behind the text's end."""
    ends = [*(b - a for a, b in zip(BLOCKS, BLOCKS[1:], strict=False)), 2**31 - 1]
    blocks = [F.when(F.length(_text()) > start, hashed(F.substring(_text(), start + 1, n))) for start, n in zip(BLOCKS, ends, strict=True)]
    return [F.length(_text()).alias("n_chars"), *[b.alias(f"b{i}") for i, b in enumerate(blocks)]]


def _split(column: Column, i: int, hashed: Callable[..., Column]) -> Column:
    """The class of a row of class ``column`` once the i-th block splits it; a text that has ended keeps its class."""
    return F.when(F.col(f"b{i}").isNull(), column).otherwise(hashed(column, F.col(f"b{i}")))


def _class(hashed: Callable[..., Column]) -> Column:
    found = hashed(F.col("n_chars"))
    for i in range(len(BLOCKS)):
        found = _split(found, i, hashed)
    return found


def refined(rows: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(class): the classes of more than one row once ``rows`` (n_chars, b0, b1, ...) are split by number of code points and
    then by one block after the other; rows that are alone in their class take no part in what follows.

    Rows of a class are counted where they are read before anything is shuffled, and those that stay are told by a join
    with the counted classes, so a class that holds most rows is a few rows of a shuffle."""
    left, turns = rows.withColumn("class", hashed(F.col("n_chars"))), len(BLOCKS)
    for i in range(turns + 1):
        classes = checkpoint(left.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"))
        if i == turns or classes.isEmpty():
            return classes
        left = left.join(small(classes), "class", "left_semi").withColumn("class", _split(F.col("class"), i, hashed))
    raise AssertionError("not reached")


def different_texts(docs: DataFrame, classes: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(class, text, first, n): the different whole texts among the rows of ``classes``, their smallest doc_id and rows.

    Only texts of these classes are shuffled.  Copies are combined inside each task, then in parts, then all."""
    found = docs.select("doc_id", "text", *_hashes(hashed)).withColumn("class", _class(hashed)).join(small(classes), "class", "left_semi")
    found = found.select("class", _text().alias("text"), "doc_id", (F.spark_partition_id() % PARTS).alias("part"))
    found = found.groupBy("class", "text", "part").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.groupBy("class", "text").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def marked(docs: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs`` (doc_id, text, source): its source, and the filters that fail it, E among
    them if its text is also that of a smaller doc_id.

    One pass over the texts leaves a row of fixed width and the source for each document: failures, number of code points,
    hashes of blocks.  These are refined to classes that may hold copies, and the texts of such classes are read again and
    compared.  Where a class turns out to be one text, its rows are told by the class; a class of several texts, whose
    hashes collide, has its rows told by their texts."""
    rows = failures(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "mask", *_hashes(hashed))
    rows = checkpoint(rows)
    classes = refined(rows.drop("doc_id", "part", "mask"), hashed)
    rows = rows.withColumn("class", _class(hashed)).select("doc_id", "part", "mask", "class")
    texts = different_texts(docs, classes, hashed)
    texts = checkpoint(texts.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")))
    one = texts.where("texts = 1").select("class", "first")
    several = texts.where("texts > 1").select("class")
    again = F.when(F.col("doc_id") > F.col("first"), DUPLICATE).otherwise(0)
    out = lambda x: x.select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    if several.isEmpty():
        return out(rows.join(small(one), "class", "left"))
    alone = rows.join(small(several), "class", "left_anti").join(small(one), "class", "left")
    whole = failures(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "mask", _text().alias("text"), *_hashes(hashed)).withColumn("class", _class(hashed)).join(small(several), "class", "left_semi")
    firsts = different_texts(docs, several, hashed).where("n > 1").select("class", "text", "first")
    return out(alone).union(out(whole.join(firsts, ["class", "text"], "left")))


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each source arrays of 32, by mask, of documents, of those labelled quality=1, and toxic=1."""
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")]
    counts = rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(*sums)
    # at most 32 masks a part
    counts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("_by"))
    masks = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    of = lambda name: F.transform(masks, lambda m: F.coalesce(F.try_element_at("_by", m)[name], F.lit(0).cast("long"))).alias(name)
    return counts.select("part", of("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each source (part), order of the five filters and step there: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, from the counts of documents by the filters that fail them.

    A null text is empty, a null source the empty string.  A text of any length is read whole.  A doc_id that repeats with
    one text isn't smaller than itself, so its rows are no duplicates of each other; a null doc_id is neither smaller nor
    larger than others.  Rows of ``labels`` (doc_id, quality, toxic) that repeat a doc_id count once: it is good, or toxic,
    if one of them says so; those of a null doc_id count for none.  Rows that are equal in all columns are documents each.
    An empty table gives no row.  Further columns are ignored, whatever their names."""
    docs, labels = docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counted(marked(docs), labels).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [F.instr("filter_order", x) for x in FILTERS]
    rows = rows.withColumn("_own", sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(at)), F.lit(0)))
    rows = rows.withColumn("_before", sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(at)), F.lit(0)))
    masks, own, before = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)), F.col("_own"), F.col("_before")

    def total(values: str, where: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(where(m), F.get(values, m) * times(m)).otherwise(0))

    first_in = F.array(*[F.lit(factorial(len(FILTERS)) // max(1, m.bit_count())).cast("long") for m in range(2 ** len(FILTERS))])
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of the filters that fail a document, each comes first in as many orders
        total("n", lambda m: m.bitwiseAND(own) != 0, lambda m: F.get(first_in, m)).alias("shapley"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
judged AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
         coalesce(doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL), false) AS toxic
  FROM words
), failed AS (
  SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END ||
         CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS f FROM judged
), counts AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
each AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, f, n, good, toxic,
         contains(f, substr(filter_order, step, 1)) AS fails,
         len(list_filter(string_split(left(filter_order, step - 1), ''), lambda x: x <> '' AND contains(f, x))) > 0 AS gone
  FROM counts, steps
), out AS (
  SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM each GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM out
"""
