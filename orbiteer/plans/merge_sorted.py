"""Merging tables by what their footers say: files whose times don't overlap keep their order, and only others are sorted."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c
from ..functions.time import compose
from ..operators.merge import merge
from ..schemas import DATE, TIME, TIME_SYSTEM
from ..sources.archive import listed, opened
from ..sources.commits import Store
from ..sources.tables import BROADCAST_FILES, plain_path, put

_RANGES = "path string, row_group int, rows long, low long, high long, constant string"


def _micros(value) -> int | None:
    """A statistic as a number that keeps its order: microseconds of a date or time."""
    if isinstance(value, dt.datetime):
        return (value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days * 86_400_000_000
    return value if isinstance(value, int) else None


def _read_footers(column: str, constant: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        def of(group, name):
            for i in range(group.num_columns):
                if group.column(i).path_in_schema.strip("`") == name:
                    return group.column(i).statistics
            return None

        for files in batches:
            for path in files["path"]:
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    meta = pq.ParquetFile(file).metadata
                rows = []
                for i in range(meta.num_row_groups):
                    group = meta.row_group(i)
                    times, same = of(group, column), of(group, constant) if constant else None
                    whole = times is not None and times.has_min_max and times.null_count == 0
                    one = str(same.min) if same is not None and same.has_min_max and same.null_count == 0 and same.min == same.max else None
                    rows.append((path, i, group.num_rows, _micros(times.min) if whole else None, _micros(times.max) if whole else None, one))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RANGES.split(", ")]).astype({"low": "Int64", "high": "Int64"})

    return run


def ranges(spark: SparkSession, paths: Sequence[str], column: str, constant: str | None = None) -> DataFrame:
    """(path, row_group, rows, low, high, constant) of each row group of the Parquet files in ``paths``: the limits of
    ``column``, in microseconds for dates and times, null where the footer doesn't say or there are nulls; and the value of
    ``constant`` if it is one.  Tasks read footers, nothing else."""
    files = [(p,) for path in paths for p, _ in listed(path) if p.endswith(".parquet")]
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(files, "path string").repartition(tasks).mapInPandas(_read_footers(column, constant), _RANGES)


@dataclass(frozen=True)
class Group:
    """Files whose ranges overlap one another, in order of their times; ``sorts`` if their rows must be sorted across tasks."""

    paths: tuple[str, ...]
    sorts: bool


def groups(files: Sequence[tuple[str, int | None, int | None, bool]]) -> list[Group]:
    """Groups of (path, low, high, in_order), such that all of a group lies before all of the next; in_order: the row groups
    of the file follow each other.  A file without limits overlaps all others."""
    if any(low is None or high is None for _, low, high, _ in files):
        return [Group(tuple(f[0] for f in files), True)] if files else []
    out: list[list] = []
    end = None
    for path, low, high, in_order in sorted(files, key=lambda f: (f[1], f[2], f[0])):
        if out and low <= end:
            out[-1].append((path, in_order))
        else:
            out.append([(path, in_order)])
        end = high if end is None else max(end, high)
    return [Group(tuple(p for p, _ in g), len(g) > 1 or not g[0][1]) for g in out]


def _staged(spark: SparkSession, plan: list[Group], drop: bool, range_sort: bool) -> DataFrame:
    """The rows of the groups that are (or aren't) to be sorted across tasks, with their group's number, by time within tasks."""
    chosen = [(re.sub("^file:/+", "/", p), i) for i, g in enumerate(plan) if g.sorts == range_sort for p in g.paths]
    known = spark.createDataFrame(chosen, "_file string, _group int")
    known = F.broadcast(known) if len(chosen) <= BROADCAST_FILES else known
    rows = spark.read.parquet(*[p for p, _ in chosen]).withColumn("_file", plain_path(F.col("_metadata.file_path")))
    rows = rows.join(known, "_file").drop("_file")
    if drop:
        rows = rows.drop(c(TIME_SYSTEM))
    if DATE in rows.columns and TIME in rows.columns:
        rows = rows.withColumn("timestamp", compose(c(DATE), c(TIME))).drop(c(DATE), c(TIME))
    if range_sort:
        rows = rows.repartitionByRange("_group", "timestamp")
    return rows.sortWithinPartitions("_group", "timestamp")


def merge_sorted(spark: SparkSession, paths: Sequence[str], out: str) -> list[Group]:
    """Writes the rows of decoded tables to ``out`` by time, as ``operators.merge.merge`` has them, and returns the groups.

    A first job reads footers: limits of the date (or timestamp) of each row group, and the time system, which goes if it is one
    throughout.  One row a file comes to the driver, where files that don't overlap become groups of their own.  Their rows are
    only sorted inside the tasks that read them, nothing is shuffled; those of groups of several files, or of a file whose row
    groups overlap, are sorted across tasks by range.  The footers of what was written then tell the order of the files, which
    are named by it.  If they overlap after all (rows out of order in a file that several tasks read), all rows are sorted."""
    first = spark.read.parquet(paths[0]).columns
    column = "timestamp" if "timestamp" in first else DATE
    found = ranges(spark, paths, column, TIME_SYSTEM if TIME_SYSTEM in first else None)
    order = F.transform(F.array_sort(F.collect_list(F.struct("row_group", "low", "high"))), lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high")))
    files = found.groupBy("path").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and(F.col("low").isNotNull()).alias("known"), order.alias("order"), F.min("constant").alias("c0"), F.max("constant").alias("c1"), F.bool_and(F.col("constant").isNotNull()).alias("same"))
    follow = F.forall(F.zip_with(F.slice("order", 1, F.size("order") - 1), F.slice("order", 2, F.size("order")), lambda a, b: a["high"] < b["low"]), lambda x: x)
    rows = files.select("path", "low", "high", "known", F.coalesce(follow, F.lit(False)).alias("in_order"), "c0", "c1", "same").collect()
    plan = groups([(r["path"], r["low"] if r["known"] else None, r["high"] if r["known"] else None, r["in_order"]) for r in rows])
    drop = TIME_SYSTEM in first and all(r["same"] for r in rows) and len({x for r in rows for x in (r["c0"], r["c1"])}) == 1
    place = out.rstrip("/")
    stage = f"{place}-stage-{uuid.uuid4().hex}"
    try:
        for range_sort in (False, True):
            if any(g.sorts == range_sort for g in plan):
                _staged(spark, plan, drop, range_sort).write.mode("append").partitionBy("_group").parquet(stage)
        written = ranges(spark, [stage], "timestamp").groupBy("path").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        written = sorted(written, key=lambda r: (r["low"] is None, r["low"], r["high"]))
        whole = all(r["low"] is not None for r in written) and all(a["high"] <= b["low"] for a, b in zip(written, written[1:], strict=False))
        if whole:
            _put(spark, [r["path"] for r in written], stage, place)
        else:
            merge([spark.read.parquet(p) for p in paths]).write.mode("overwrite").parquet(place)
    finally:
        Store(spark, stage).delete()
    return plan


def _put(spark: SparkSession, files: list[str], stage: str, place: str) -> None:
    """Moves ``files`` to a folder in this order, and the folder to its place."""
    store, path = Store(spark, stage), spark._jvm.org.apache.hadoop.fs.Path
    store.files.mkdirs(store.path("whole"))
    for i, name in enumerate(files):
        store.files.rename(path(name), store.path("whole", f"part-{i:06d}.parquet"))
    store.create("", "whole", "_SUCCESS")
    put(spark, f"{stage}/whole", place)
