"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, small, table

#: Weights of the sources by rank of name, repeating, and the most copies of a document or a source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents in a slice of the sampling order, about, and slices in a group of slices.
SLICE, GROUP = 256, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(doc_id: Column, text: Column, seed: int) -> Column:
    """MD5 of doc_id, seed and text: rows that differ in one of them get different random numbers."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))


def uniform(hexadecimal: Column) -> Column:
    """A number above 0 and below 1 from the first digits of a digest."""
    return (F.conv(F.substring(hexadecimal, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of each source of ``sizes`` (source, size): source, docs, source_size and target.

    Sources in order of code points, null last, have ``weights`` in turn and share all sizes by them; none gets more
    than ``most`` times its own, and what that leaves over is shared out again.  The shares end at one level: each
    target is the level times the weight, or the limit where that is less.  In order of limit over weight, the first
    source whose limit is not below what is left for it and those after it sets the level."""
    source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    source = source.withColumn("weight", weight.cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    source = source.withColumn("level", left.cast("double") / share)
    limit = F.col("source_size").cast("double") * most
    fits = F.col("level") * F.col("weight") <= limit
    level = F.coalesce(F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("source_size") / F.col("weight"))).over(whole), F.lit(0.0))
    return source.withColumn("target", F.least(level * F.col("weight"), limit)).select("source", "docs", "source_size", "target")


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def with_scale(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """``known`` (source, room and others) with ``scale``: a document's inclusion probability is scale * size, at most 1,
    and by those the sample is expected to have ``room`` words.

    Over the different sizes of a source, from the largest: with the sizes so far certain, what they leave of the room,
    divided by the sum of squares of the rest, is the scale; the first that leaves no other above 1 holds."""
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.alias("a").join(small(known.select("source", "room")).alias("b"), _same_source("a", "b")).select("a.source", "size", "n", "room")
    exact = lambda c: c.cast("decimal(38,0)")
    words, squares = exact(F.col("n")) * exact(F.col("size")), (exact(F.col("n") * F.col("size")).cast("decimal(25,0)") * F.col("size").cast("decimal(12,0)")).cast("decimal(38,0)")
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    before, whole = falling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    taken, gone = (F.coalesce(F.sum(x.cast("decimal(28,0)")).over(before), F.lit(0)).cast("double") for x in (words, squares))
    counts = counts.withColumn("scale", (F.col("room") - taken) / (F.sum(squares.cast("decimal(28,0)")).over(whole).cast("double") - gone))
    fits = counts.where(F.col("scale") * F.col("size") <= 1).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))
    known = known.alias("a").join(fits.alias("b"), _same_source("a", "b"), "left")
    return known.select("a.*", F.greatest(F.coalesce("b.scale", F.lit(0.0)), F.lit(0.0)).alias("scale"))


def pareto(u: Column, size: Column, scale: Column) -> Column:
    """The sampling key: random odds over inclusion odds; the smallest keys are in the sample.  0 for what is certain,
    null for what has no odds."""
    chance = F.least(F.lit(1.0), scale * size)
    return F.when(chance >= 1, 0.0).when(chance > 0, u / (1 - u) / (chance / (1 - chance)))


def slice_of(key: Column, slices: Column) -> Column:
    """The slice of the order that a key falls in, counting from 0; where the sample ends, at keys about 1, slices hold
    ``SLICE`` documents or less on average."""
    return F.least(slices - 1, F.floor(key / (1 + key) * slices)).cast("long")


def place(key: Column, doc_id: Column, size: Column, u: Column) -> Column:
    """A document's place in the order; equal rows share one."""
    return F.struct(key.alias("key"), F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), size.alias("size"), u.alias("u"))


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of ``sizes`` (doc_id, source, size, u): source_size, target, copies, scale, slices, and where its
    sample ends (limit, cut)."""
    known = targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = known.withColumn("copies", F.floor(rate).cast("long")).withColumn("room", F.col("target") - F.col("copies") * F.col("source_size"))
    known = known.withColumn("slices", F.ceil(F.col("docs") / SLICE).cast("long"))
    known = checkpoint(with_scale(checkpoint(known), sizes))

    ranked = sizes.alias("a").join(small(known).alias("b"), _same_source("a", "b"))
    ranked = ranked.select("a.doc_id", "a.size", "a.u", "b.source", "b.slices", "b.room", pareto(F.col("a.u"), F.col("a.size"), F.col("b.scale")).alias("key")).where("key is not null")
    ranked = ranked.withColumn("slice", slice_of(F.col("key"), F.col("slices")))
    slices = checkpoint(ranked.groupBy("source", "slice", "room").agg(F.sum("size").alias("size")))
    # the slice in which the running sum passes the room: first by groups of slices, then inside that group
    group = F.floor(F.col("slice") / GROUP)
    over_groups = Window.partitionBy("source").orderBy("g")
    groups = slices.groupBy("source", group.alias("g"), "room").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(over_groups))
    at_group = groups.where("upto > room").groupBy("source").agg(F.min_by(F.struct("g", (F.col("upto") - F.col("size")).alias("before")), "g").alias("x")).select("source", "x.*")
    inside = slices.alias("a").join(at_group.alias("b"), _same_source("a", "b") & (group == F.col("b.g"))).select("a.source", "a.slice", "a.room", "a.size", "b.before")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("slice")))
    limit = inside.where("upto > room").groupBy("source").agg(F.min_by(F.struct(F.col("slice").alias("limit"), (F.col("upto") - F.col("size")).alias("before")), "slice").alias("x")).select("source", "x.*")
    limit = checkpoint(limit)

    # in it, document by document: the last one is in if that misses the room by no more
    near = ranked.alias("a").join(small(limit).alias("b"), _same_source("a", "b") & (F.col("a.slice") == F.col("b.limit")))
    near = near.select("a.source", place(F.col("a.key"), F.col("a.doc_id"), F.col("a.size"), F.col("a.u")).alias("place"), "a.size", "a.room", "b.before")
    near = near.groupBy("source", "place", "room", "before").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    cut = near.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("room")).groupBy("source").agg(F.max("place").alias("cut"))
    out = known.alias("a").join(limit.alias("b"), _same_source("a", "b"), "left").join(cut.alias("c"), _same_source("a", "c"), "left")
    return checkpoint(out.select("a.source", "a.source_size", "a.target", "a.copies", "a.scale", "a.slices", F.coalesce("b.limit", "a.slices").alias("limit"), "c.cut"))


def n_copies(doc_id: Column, size: Column, u: Column, source: Column) -> Column:
    """How many copies the mix takes of a document; ``source`` is a struct of a row of ``plan``."""
    key = pareto(u, size, source["scale"])
    own = slice_of(key, source["slices"])
    chosen = (own < source["limit"]) | ((own == source["limit"]) & (place(key, doc_id, size, u) <= source["cut"]))
    return source["copies"] + F.coalesce((key.isNotNull() & chosen).cast("int"), F.lit(0))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and random number of each document."""
    doc_id = F.col("doc_id").cast("long")
    return checkpoint(docs.select(doc_id.alias("doc_id"), "source", n_words(F.col("text")).alias("size"), uniform(digest(doc_id, F.col("text"), seed)).alias("u")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), with mix_size, mix_source_size, mix_target and mix_copies.

    A document's size is its words (``common.WORD``; 0 for a null or empty text).  See ``targets`` for those of the sources.
    A source takes the whole part of target over size as certain copies of all its documents.  One more copy goes to a
    sample with unequal probabilities, in proportion to size (``with_scale``), whose size in words is fixed by what the
    target leaves: documents in Pareto order, of random odds over inclusion odds, as far as that goes, which misses the
    target by at most half of the last one.  The order is cut into slices of about 256 documents, of which only that where
    the sample ends is looked at document by document.

    Nothing depends on partitions: reruns agree.  A null source is a source.  A null doc_id is one like others; rows that
    are equal in doc_id and text are taken both or not at all.  An empty table gives no row; a long text is read whole.
    Columns of the added names are replaced."""
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_plan", "mix_u")
    known = plan(measured(docs, seed), weights, most)
    columns = [c for c in known.columns if c != "source"]
    known = known.select(F.struct("source", *columns).alias("mix_plan"))
    given = docs.withColumn("mix_size", n_words(F.col("text"))).withColumn("mix_u", uniform(digest(F.col("doc_id").cast("long"), F.col("text"), seed)))
    out = given.join(small(known), given["source"].eqNullSafe(F.col("mix_plan.source")))
    of = F.col("mix_plan")
    copies = n_copies(F.col("doc_id").cast("long"), F.col("mix_size"), F.col("mix_u"), of)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", of["source_size"].alias("mix_source_size"), of["target"].alias("mix_target"), copies.alias("mix_copies"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), 4)
    known = plan(sizes)
    known = known.select(F.struct(*known.columns).alias("of"))
    taken = F.col("size") * n_copies(F.col("doc_id"), F.col("size"), F.col("u"), F.col("of"))
    return sizes.join(small(known), F.col("source").eqNullSafe(F.col("of.source"))).select("doc_id", "size", "of.source_size", "of.target", taken.alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':4:' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(coalesce(min_by(CASE WHEN level * weight <= source_size * 3.0::DOUBLE THEN level END,
                                  CASE WHEN level * weight <= source_size * 3.0::DOUBLE THEN source_size / weight END) OVER (), 0.0::DOUBLE) * weight,
                  source_size::DOUBLE * 3) AS target FROM l
), r AS (
  SELECT *, target - copies * source_size AS room
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t)
), c AS (
  -- scale x size is the chance of one more copy, 1 for the largest documents; it makes the expected words fill the room
  SELECT d.source, d.size, any_value(r.room) AS room,
         coalesce(sum(sum(d.size::HUGEINT)) OVER larger, 0)::DOUBLE AS certain,
         (sum(sum(d.size::HUGEINT * d.size)) OVER (PARTITION BY d.source) - coalesce(sum(sum(d.size::HUGEINT * d.size)) OVER larger, 0))::DOUBLE AS squares
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE d.size > 0 GROUP BY d.source, d.size
  WINDOW larger AS (PARTITION BY d.source ORDER BY d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (
  SELECT source, greatest(max_by((room - certain) / squares, size), 0) AS scale FROM c WHERE (room - certain) / squares * size <= 1 GROUP BY source
), k AS (
  SELECT d.*, r.source_size, r.target, r.copies, r.room, least(1.0::DOUBLE, coalesce(p.scale, 0) * d.size) AS chance
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source
), o AS (
  SELECT *, CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN u / (1 - u) / (chance / (1 - chance)) END AS pareto FROM k
), w AS (
  SELECT *, sum(CASE WHEN pareto IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY pareto NULLS LAST, doc_id NULLS FIRST, size, u) AS upto,
         sum(size) OVER (PARTITION BY source, pareto, doc_id, size, u) AS own
  FROM o
)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN pareto IS NOT NULL AND 2 * upto - own <= 2 * room THEN 1 ELSE 0 END))::BIGINT AS taken FROM w
"""
