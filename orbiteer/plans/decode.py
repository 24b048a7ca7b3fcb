"""Raw text to typed Parquet, and decoded tables to one per mission, each logged in a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import c
from ..functions.text import archive_code, mission_code
from ..operators.filters import require_rows
from ..operators.merge import merge
from ..schemas import ARCHIVE, DECODE_MANIFEST, MERGE_MANIFEST, SCHEMAS
from ..sources.commits import Store
from ..sources.tables import append_csv, scan, write
from ..sources.text import archive_columns, judged, mission_lines, verdicts


@dataclass(frozen=True)
class Decoded:
    """Where a table went, the rows that were not readable, and a verdict on each file."""

    path: str
    rejected: DataFrame
    files: DataFrame


def _decode(spark: SparkSession, lines: DataFrame, schema: T.StructType, comments: tuple[str, ...], finish: Callable[[DataFrame], DataFrame], out: str, check=None) -> Decoded:
    """Reads all lines once, to a table beside ``out`` of typed rows and of what is wrong; the verdict on a file reads two
    narrow columns of it, and the rows of good files, ``finish``ed, are written to ``out``.  Bad lines stay in ``out``-rejected,
    verdicts in ``out``-files."""
    place = out.rstrip("/")
    stage = f"{place}-lines-{uuid.uuid4().hex}"
    rows = judged(lines, schema, comments)
    if check is not None:
        rows = rows.withColumn("kind", F.when((F.col("kind") == "row") & check.isNull(), "bad").otherwise(F.col("kind")))
    try:
        rows.write.option("compression", "lz4").parquet(stage)
        rows = spark.read.parquet(stage)
        write(verdicts(rows), f"{place}-files", "lz4")
        write(rows.where("kind = 'bad'").select("path", "offset", "line_no", "tokens"), f"{place}-rejected", "lz4")
        files = scan(spark, f"{place}-files")
        good = rows.where("kind = 'row'").join(files.where("status <> 'decoded'").select("path"), "path", "left_anti")
        write(finish(require_rows(good, 9).select("path", *[c(n) for n in schema.names])).drop("path"), out, "lz4")
    finally:
        Store(spark, stage).delete()
    return Decoded(out, scan(spark, f"{place}-rejected"), files)


def _log(decoded: Decoded, manifest: str | None, mission: str, code) -> None:
    """A row for each file whose rows are in the table."""
    if manifest is not None:
        rows = decoded.files.where("status = 'decoded'").select(F.lit(mission).alias("mission"), code(F.col("member")).alias("mission_code"), F.lit(decoded.path).alias("parquet_path"), F.col("path").alias("source_path"))
        append_csv(rows, manifest, DECODE_MANIFEST)


def decode_mission(spark: SparkSession, mission: str, paths: list[str], out: str, manifest: str | None = None) -> Decoded:
    """Reads a mission's files, all at once, and writes their rows.  Files with an unreadable row, or that can't be read, are
    left out whole; their rows are returned as rejected and their verdicts with the others'.  An unknown mission, or
    nothing readable, raises."""
    if mission.upper() not in SCHEMAS:
        raise ValueError(f"unknown mission {mission!r}")
    decoded = _decode(spark, mission_lines(spark, paths), SCHEMAS[mission.upper()], ("#",), lambda rows: rows, out)
    _log(decoded, manifest, mission, mission_code)
    return decoded


def decode_archive(spark: SparkSession, paths: list[str], out: str, manifest: str | None = None) -> Decoded:
    """The same for archive files, by time; a malformed time makes a row unreadable."""
    stamp = F.try_to_timestamp("YYYYMMDDhhmm", F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    decoded = _decode(spark, mission_lines(spark, paths), ARCHIVE, ("#", ":"), lambda rows: archive_columns(rows, stamp).orderBy("timestamp"), out, stamp)
    _log(decoded, manifest, "hasdm", archive_code)
    return decoded


def merge_tables(spark: SparkSession, paths: list[str], out: str, manifest: str | None = None) -> str | None:
    """Merges decoded tables into one; of no tables it makes none."""
    if not paths:
        return None
    write(merge([scan(spark, p) for p in paths]), out)
    if manifest is not None:
        code = out.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet").removesuffix("_merged")
        append_csv(spark.createDataFrame([(code, out)], MERGE_MANIFEST), manifest, MERGE_MANIFEST)
    return out
