"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

All but the last return the columns they are given, also such as have the names of columns that an operator adds.  All
take empty tables, which stay empty, and long texts, which they read whole; what they do with nulls, ties and repeated
rows is said at each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbiteer.llm.common import checkpoint, shared_folder, small, table
from orbiteer.llm.language_id import UNDETERMINED, identify, train
from orbiteer.llm.line_dedup import drop_boilerplate
from orbiteer.llm.mixing import mix
from orbiteer.llm.near_dup import groups
from orbiteer.llm.packing import pack

#: A document whose best language has a lower probability than this is rejected.
LEAST_SCORE = 0.4


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with those columns of ``names`` that it has under other names."""
    return docs.withColumnsRenamed({n: f"_own_{n}" for n in names})


def _back(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with those that were put aside under their names again."""
    return docs.select(*[F.col(f"`_own_{c}`").alias(c) if f"_own_{c}" in docs.columns else F.col(f"`{c}`") for c in like.columns])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled ones teach.

    Texts that are null, empty or without letters go, and all if no row teaches a language; rows that repeat are judged
    alike; doc_id and source may be null."""
    found = identify(_aside(docs, "lang_pred", "score"), train(docs))
    return _back(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of their source share; n_chars follows the text.

    Copies of one text count as one page here: the next stage is to find one of them whole.  A null text stays null, a null
    source is one like others, rows that repeat are cut alike, and a row of which all lines go stays with an empty text."""
    cut = drop_boilerplate(_aside(docs, "n_lines", "n_dropped", "_common", "_kept"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(cut, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its smallest doc_id, the text of the smallest hash, and of equal
    texts of that doc_id the smallest row.

    Rows are told apart by doc_id and text: a doc_id that repeats with another text is another document.  Rows without
    a word or a doc_id are in no group and stay."""
    marks = groups(docs).where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "hash")
    marks = checkpoint(marks.agg(F.first("chosen").alias("chosen"), F.count(F.lit(1)).alias("n")).where("not chosen or n > 1"))
    hashed = _aside(docs, "hash").withColumn("hash", F.xxhash64("text"))
    out = _back(hashed.join(small(marks), ["doc_id", "hash"], "left_anti"), docs)
    again = checkpoint(marks.where("chosen"))
    if again.isEmpty():
        return out
    row = F.struct(*[F.col(f"`_own_{c}`").alias(c) if f"_own_{c}" in hashed.columns else F.col(f"`{c}`") for c in docs.columns])
    first = hashed.join(small(again), ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.min(row).alias("row"))
    return out.union(first.select("row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document, each a row, as the mix takes.

    A null source is one like others; a null or empty text has size 0, so its row is taken as often as all its source's
    are; rows that repeat in doc_id and text are taken alike."""
    aside = _aside(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_plan", "mix_u")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))).alias("_copy")
    return _back(mix(aside).select("*", copies), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.  A null or empty text is one token; each row is a document."""
    return pack(docs)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: A recurrent network and MinHash groups aren't SQL; tests/llm/test_pipeline.py has a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents of ``sf_dir``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
