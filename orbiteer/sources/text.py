"""Delimited mission and archive text, zipped or not, with the rows that can't be read set apart."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import c
from ..functions.text import is_blank, is_comment, tokens
from ..functions.time import parse_compact
from ..schemas import ALTITUDE, ARCHIVE, DENSITY, LATITUDE, LOCAL_TIME, LONGITUDE
from .archive import opened, stream_lines


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each file's first .txt member; of a file that is no zip, its own lines."""
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            name, lines = None, []
            if zipfile.is_zipfile(io.BytesIO(content)):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = next((n for n in archive.namelist() if n.lower().endswith(".txt")), None)
                    if name is not None:
                        lines = archive.read(name).decode("utf-8", "replace").split("\n")
            else:
                name, lines = path.rsplit("/", 1)[-1], content.decode("utf-8", "replace").split("\n")
            for at in range(0, max(1, len(lines)), 50_000):
                part = lines[at : at + 50_000] or [None]
                yield pd.DataFrame({"path": path, "member": name, "line_no": range(at, at + len(part)), "line": part})


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, member, line_no, line) of zip files or plain text.  A zip without a text member has one row with a null
    member.  A zip can't be split: a file is read by one task, so files are what is parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    return files.mapInPandas(_members, "path string, member string, line_no long, line string")


def normalised(lines: DataFrame, comments: tuple[str, ...] = ("#",)) -> DataFrame:
    """Lines that are neither blank nor comments, with their tokens."""
    line = F.col("line")
    return lines.where(line.isNotNull() & ~is_comment(line, comments) & ~is_blank(line)).withColumn("tokens", tokens(line))


def _value(i: int, kind: T.DataType) -> Column:
    token = F.get("tokens", F.lit(i))
    return token if isinstance(kind, T.StringType) else token.try_cast(kind)


def _checked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` (tokens) with _ok: as many tokens as columns, each of its column's type."""
    ok = F.size("tokens") == len(schema.fields)
    for i, f in enumerate(schema.fields):
        if not isinstance(f.dataType, T.StringType):
            ok = ok & _value(i, f.dataType).isNotNull()
    return rows.withColumn("_ok", ok)


def typed(rows: DataFrame, schema: T.StructType, keys: tuple[str, ...] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """Rows of ``tokens`` as columns of ``schema``, and the bad ones (keys, line_no, tokens): of another number of tokens,
    or with one that isn't of its column's type.  A file with a bad row is rejected whole, as a strict reader would."""
    # conditions don't pass below explode, else each of their columns would make the tokens again
    rows = rows.withColumn("tokens", F.explode(F.array("tokens")))
    # an indented comment is one once its blanks are gone
    rows = _checked(rows.where(~F.get("tokens", F.lit(0)).startswith("#")), schema)
    bad = rows.where(~F.col("_ok"))
    good = rows.join(bad.select(*keys).distinct(), list(keys), "left_anti")
    return good.select(*keys, *[_value(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]), bad.select(*keys, "line_no", "tokens")


def judged(lines: DataFrame, schema: T.StructType, comments: tuple[str, ...] = ("#",)) -> DataFrame:
    """Each row of ``lines`` once, told apart by ``kind``: "row" (of ``schema``'s columns), "bad" (with its tokens), "error" (its
    file can't be read; with the error), "none" (its file has no text) or "blank" (nothing to read: a comment or an empty
    line, of which only the first of each range stays, so a file without rows is known)."""
    # what is dropped is told by the line alone: a condition on the tokens would be made of the line again for each column
    line = F.col("line")
    blank = line.isNull() | is_comment(line, comments) | is_blank(line, "#")
    rows = lines.where(F.col("error").isNotNull() | F.col("member").isNull() | ~blank | (F.col("line_no") == 0))
    rows = rows.withColumns({"_blank": blank, "tokens": tokens(line)})
    values = {f.name: _value(i, f.dataType) for i, f in enumerate(schema.fields)}
    rows = rows.select("path", "member", "offset", "line_no", "error", "_blank", "tokens", *[v.alias(n) for n, v in values.items()])
    ok = reduce(and_, [c(f.name).isNotNull() for f in schema.fields if not isinstance(f.dataType, T.StringType)], F.size("tokens") == len(schema.fields))
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("member").isNull(), "none").when(F.col("_blank"), "blank").when(ok, "row").otherwise("bad")
    rows = rows.withColumn("kind", kind)
    columns = [F.when(F.col("kind") == "row", c(n)).alias(n) for n in values]
    return rows.select("path", "member", "offset", "line_no", "kind", "error", F.when(F.col("kind") == "bad", F.col("tokens")).alias("tokens"), *columns)


def verdicts(rows: DataFrame) -> DataFrame:
    """(path, member, rows, bad_rows, status, error) of each file of ``judged`` rows: decoded, rejected (a bad row), unreadable,
    no_text or empty."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    # counts alone are kept by hash; the greatest of strings would sort all rows
    counts = rows.groupBy("path", "member", "error").agg(n("row").alias("rows"), n("bad").alias("bad_rows"))
    files = counts.groupBy("path").agg(F.max("member").alias("member"), F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"), F.max("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("member").isNull(), "no_text").when(F.col("bad_rows") > 0, "rejected")
    return files.select("path", "member", "rows", "bad_rows", status.when(F.col("rows") == 0, "empty").otherwise("decoded").alias("status"), "error")


def mission_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of files, streamed (``archive.stream_lines``), or through Spark's reader of whole files where only that one
    reaches them."""
    try:
        for path in [paths] if isinstance(paths, str) else paths:
            opened(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return read_lines(spark, paths).select("path", "member", F.lit(0).cast("long").alias("offset"), "line_no", "line", F.lit(None).cast("string").alias("error"))
    return stream_lines(spark, paths)


def read_mission(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return mission_rows(read_lines(spark, paths), schema)


def mission_rows(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return typed(normalised(lines), schema)


def read_archive(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return archive_rows(read_lines(spark, paths))


def archive_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archive text with kilometres as metres and a timestamp; a malformed stamp raises."""
    rows, bad = typed(normalised(lines, ("#", ":")), ARCHIVE)
    return archive_columns(rows, parse_compact(F.col("YYYYMMDDhhmm"))), bad


def archive_columns(rows: DataFrame, stamp: Column) -> DataFrame:
    return rows.select(
        "path",
        "JulianDay",
        (F.col("HTM") * 1000.0).alias(ALTITUDE),
        c("LON").alias(LONGITUDE),
        c("LAT").alias(LATITUDE),
        c("LST").alias(LOCAL_TIME),
        c("RHO").alias(DENSITY),
        stamp.alias("timestamp"),
    )
