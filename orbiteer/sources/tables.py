"""Reading and writing tables: Parquet with its metadata, manifests, space weather."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.numeric import c
from ..schemas import DOWNLOAD_MANIFEST, SPACE_WEATHER
from .commits import CommittedTable

#: Folders of a manifest that are put together to one.
COMPACT = 32
#: Rows of a list of files up to which it is broadcast; beyond it a join shuffles.
BROADCAST_FILES = 100_000


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of tables: folders of Parquet or committed tables, whose last version is read."""
    committed = [CommittedTable(spark, p).read() for p in paths if CommittedTable.is_one(spark, p)]
    plain = [p for p in paths if not CommittedTable.is_one(spark, p)] if committed else list(paths)
    for p in plain:
        recover(spark, p)
    frames = ([spark.read.parquet(*plain)] if plain else []) + committed
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _siblings(spark: SparkSession, path: str):
    """A table's place, its file system, and the folders beside it that a replacement makes, by name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if target.getParent() is not None and files.exists(target.getParent()):
        for status in files.listStatus(target.getParent()):
            if re.fullmatch(re.escape(target.getName()) + r"-(new|old)-[0-9a-f]{32}", status.getPath().getName()):
                found.append(status)
    return target, files, found


def recover(spark: SparkSession, path: str) -> bool:
    """Ends a replacement by ``write`` that was stopped after the old table was moved away: the new one is put there if it is
    complete, else the old one is put back.  A table that is there is left alone."""
    if re.search(r"[*?{\[]", path):
        return False
    target, files, beside = _siblings(spark, path)
    if not beside or files.exists(target):
        return False
    of = lambda kind: sorted((s for s in beside if f"-{kind}-" in s.getPath().getName()), key=lambda s: s.getModificationTime())
    whole = [s for s in of("new") if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    for status in reversed(of("old") + whole):
        if files.rename(status.getPath(), target):
            return True
    return False


def write(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> None:
    """Parquet.  With "overwrite" the table is written beside its place and then put there, so a job that fails leaves the
    old table as it was, and a plan may read the table it replaces; if the driver stops between the two renames, the next
    ``scan`` or ``write`` ends the replacement.  With "versioned" a committed table gets a further version."""
    if mode == "versioned":
        CommittedTable(df.sparkSession, path, compression=compression).replace(df)
        return
    if mode != "overwrite":
        df.write.mode(mode).option("compression", compression).parquet(path)
        return
    spark = df.sparkSession
    recover(spark, path)
    target, files, _ = _siblings(spark, path)
    beside = target.suffix(f"-new-{uuid.uuid4().hex}")
    try:
        df.write.option("compression", compression).parquet(beside.toString())
        put(spark, beside.toString(), path)
    finally:
        if files.exists(beside):
            files.delete(beside, True)


def put(spark: SparkSession, made: str, path: str) -> None:
    """Renames the folder ``made`` to ``path``, whose old table, if there is one, goes."""
    target, files, _ = _siblings(spark, path)
    files.mkdirs(target.getParent())
    old = target.suffix(f"-old-{uuid.uuid4().hex}") if files.exists(target) else None
    if old is not None:
        files.rename(target, old)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(made), target):
        if old is not None:
            files.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    if old is not None:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)


def plain_path(path: Column) -> Column:
    """A path of Spark's metadata as file systems have it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def append_csv(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Appends rows to a manifest kept as CSV: unknown columns go, missing ones are empty.

    A manifest is a committed table, so several writers lose nothing; once it has ``COMPACT`` folders they become one file.
    One that is a plain folder of CSV stays one."""
    spark = df.sparkSession
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows = df.select(*columns)
    log = _manifest(spark, path, schema)
    if not CommittedTable.is_one(spark, path) and log.store.names():
        rows.coalesce(1).write.mode("append").option("header", True).csv(path)
        return
    log.append(rows, one_file=True)
    if len(log.folders()) >= COMPACT:
        log.compact()


def _manifest(spark: SparkSession, path: str, schema: T.StructType) -> CommittedTable:
    return CommittedTable(spark, path, schema, "csv", header="true")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A manifest kept as CSV, empty if it isn't there yet."""
    if CommittedTable.is_one(spark, path):
        return _manifest(spark, path, schema).read()
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_download_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON manifests, one in each file or, with ``lines``, one on each line."""
    return spark.read.schema(DOWNLOAD_MANIFEST).option("multiLine", not lines).json(path)


def read_space_weather(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Daily indices from CSV with a header.  Columns are found by name, in any order and beside any others, and only those of
    the schema are read: F10.7 in a name is F107, and a DATE stands for YEAR, MONTH and DAY.  A column that isn't there, or
    a value that isn't of its column's type, is null; without days, and for files whose headers differ, it raises."""
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    found = {name.strip().replace("F10.7", "F107"): c(name) for name in rows.columns}
    if "DATE" in found:
        day = F.try_to_date(found["DATE"], "yyyy-MM-dd")
        found |= {"YEAR": F.year(day), "MONTH": F.month(day), "DAY": F.dayofmonth(day)}
    elif not {"YEAR", "MONTH", "DAY"} <= found.keys():
        raise ValueError(f"no days in {path}")
    return rows.select([found.get(f.name, F.lit(None).cast("string")).try_cast(f.dataType).alias(f.name) for f in SPACE_WEATHER.fields])


def _footers(batches):
    """Rows of each row group of Parquet files, of which only the footers are read."""
    import pandas as pd
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for files in batches:
        for path in files["path"]:
            system, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with system.open_input_file(place) as file:
                meta = pq.ParquetFile(file).metadata
            yield pd.DataFrame({"path": path, "row_group": range(meta.num_row_groups), "rows": [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]})


def row_groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, row_group, rows) of Parquet files, from their footers, by tasks.  The files must be where pyarrow's file
    systems reach them (local, HDFS, S3 and the like)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
    return files.select("path").repartition(max(1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(_footers, "path string, row_group int, rows long")
