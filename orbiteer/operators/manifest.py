"""Manifests: logs of what was decoded, computed or downloaded, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_parts, shortened
from ..functions.time import now_iso


def upsert(old: DataFrame, new: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """One row for each key of both tables: the one of highest ``order``, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct("_new", order)).alias("row"))
    return latest.select("row.*")


def entries(manifest: DataFrame) -> DataFrame:
    """The entries of JSON manifests, one row each, with their defaults."""
    rows = manifest.select(F.coalesce("dataset", F.lit("unknown")).alias("dataset"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.inline("entries"))
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in ("path", "url", "timestamp")} | {"status": F.coalesce("status", F.lit("unknown"))})


def completed(runs: DataFrame) -> DataFrame:
    """(source_file): the files that succeeded once, even if a later run failed."""
    return runs.where((F.col("status") == "success") & (F.col("source_file") != "")).select("source_file").distinct()


def pending(files: DataFrame, runs: DataFrame | None, outputs: DataFrame, resume: bool = True, skip_existing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Files still to do, and those skipped with the reason, of ``files`` (source_file, output_file).

    A file that the log has as done is skipped if its output (in ``outputs``, output_file) exists, else done again.
    Any other whose output exists is skipped too, if ``skip_existing``.  Both are joins, whatever the numbers."""
    there = files.join(outputs.select("output_file").distinct().withColumn("_exists", F.lit(True)), "output_file", "left")
    done = completed(runs) if runs is not None and resume else files.select("source_file").limit(0)
    there = there.join(done.withColumn("_done", F.lit(True)), "source_file", "left")
    exists, was_done = F.col("_exists").isNotNull(), F.col("_done").isNotNull()
    reason = F.when(exists & was_done, "manifest").when(exists & F.lit(skip_existing), "output_exists")
    judged = there.withColumn("reason", reason).drop("_exists", "_done")
    return judged.where("reason is null").drop("reason").select(files.columns), judged.where("reason is not null").select(*files.columns, "reason")


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def batch_estimate(groups: DataFrame, rows: str = "rows", batch: int = 100_000) -> DataFrame:
    """One row (batches): how many batches files take whose row groups have so many ``rows``."""
    return groups.agg(F.sum(F.ceil(F.col(rows) / batch)).cast("long").alias("batches"))


def download_needed(exists, size, overwrite: bool):
    """Whether a file is to be fetched: it isn't there, is empty, or is to be written anew."""
    return F.lit(overwrite) | ~F.coalesce(exists, F.lit(False)) | (F.coalesce(size, F.lit(0)) == 0)


def valid_response(url, content_type, code):
    """Whether an answer is the file: not from a login host, not HTML, and code 200."""
    return ~F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).startswith("login."), F.lit(False)) & ~F.lower(content_type).startswith("text/html") & (code == 200)


def fetch_plan(wanted: DataFrame, there: DataFrame, overwrite: bool = False) -> DataFrame:
    """``wanted`` (path and any others) with needed: whether the file is to be fetched, as ``there`` (path, size) lists what is in
    place.  A path that is listed twice counts with its larger size."""
    sizes = there.groupBy("path").agg(F.max("size").alias("_size"), F.lit(True).alias("_there"))
    found = wanted.join(sizes, "path", "left")
    return found.withColumn("needed", download_needed(F.col("_there"), F.col("_size"), overwrite)).drop("_size", "_there")


def answered(reports: DataFrame, at: Column | None = None) -> DataFrame:
    """Manifest entries (path, url, status, timestamp, size_bytes, error) of what fetches report: ``reports`` has path, size and
    line, which tells the answer's code, content type and address.

    downloaded: the answer is the file and not empty; else failed, with what it was as the error.  A line that tells
    less is a failure too.  ``at``: the time of the entries, else now in UTC."""
    parts = answer_parts(F.coalesce("line", F.lit("")))
    code, kind, url = F.get(parts, F.lit(0)).try_cast("int"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.get(parts, F.lit(2))
    told = F.coalesce(valid_response(url, kind, code), F.lit(False)) & url.isNotNull()
    good = told & (F.coalesce("size", F.lit(0)) > 0)
    error = F.when(told, "empty answer").otherwise(shortened(F.concat(F.lit("not a file: "), F.coalesce("line", F.lit(""))), 200))
    return reports.select(
        "path",
        F.coalesce(url, F.lit("")).alias("url"),
        F.when(good, "downloaded").otherwise("failed").alias("status"),
        (now_iso() if at is None else at).alias("timestamp"),
        F.when(good, F.col("size")).cast("long").alias("size_bytes"),
        F.when(~good, error).alias("error"),
    )
