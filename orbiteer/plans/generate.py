"""Model densities for many files, resumable, with a log of each file's run."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import renamed
from ..operators.manifest import pending
from ..operators.model import DensityModel, densities_by_file
from ..operators.weather import ap_history, attach_daily, slot_of, with_day
from ..schemas import RUN_MANIFEST
from ..sources.archive import listed, opened
from ..sources.commits import Store
from ..sources.tables import BROADCAST_FILES, append_csv, plain_path, put, read_csv

BATCH = 100_000


def with_forcing(rows: DataFrame, space_weather: DataFrame) -> DataFrame:
    """``rows`` with f107 (of the day before), f107a, qflag and the history of geomagnetic indices (aps)."""
    daily = with_day(space_weather).select("date", F.col("F107_OBS").alias("f107"), F.col("F107_DATA_TYPE").alias("qflag"))
    mean = with_day(space_weather).select("date", F.col("F107_OBS_CENTER81").alias("f107a"))
    rows = attach_daily(attach_daily(rows, daily, lag_days=1), mean)
    history = ap_history(space_weather)
    return rows.join(history, slot_of() == history["slot"], "left").drop("slot")


def output_path(source: str, old: str = "merged", new: str = "msis") -> str:
    return source.replace(old, new)


def existing(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Those outputs of ``files`` that are there, asked of their file system, many at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(conf).exists(path)

    names = [r["output_file"] for r in files.select("output_file").distinct().collect()]
    with ThreadPoolExecutor(16) as pool:
        found = [(name,) for name, yes in zip(names, pool.map(there, names), strict=True) if yes]
    return spark.createDataFrame(found, "output_file string")


class _Told(AccumulatorParam):
    """Sums up what tasks tell of each file: an error, if any, and seconds."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):  # noqa: N802
        for number, (error, seconds) in b.items():
            known = a.get(number, (None, 0.0))
            a[number] = (known[0] or error, known[1] + seconds)
        return a


def _footer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of files (number, source): their data files, rows and columns, or why they can't be read."""
    import pyarrow.parquet as pq

    for files in batches:
        rows = []
        for number, source in zip(files["number"], files["source"], strict=True):
            try:
                parts = [p for p, _ in listed(source) if p.rsplit("/", 1)[-1].endswith(".parquet")]
                found = []
                for part in parts:
                    system, place = opened(part)
                    with system.open_input_file(place) as file:
                        meta = pq.ParquetFile(file)
                        found.append((number, part, meta.metadata.num_rows, str(sorted((f.name, str(f.type)) for f in meta.schema_arrow)), None))
                if not sum(f[2] for f in found):
                    raise ValueError("the table has no rows")
                rows += found
            except Exception as error:  # one file's failure is a row
                rows.append((number, None, 0, None, str(error)[:240] or type(error).__name__))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FOOTERS.split(", ")])


_FOOTERS = "number int, path string, rows long, columns string, error string"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it Arrow batches have so many rows; the session's own number is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _one_plan(spark: SparkSession, sources: dict[int, str], outputs: dict[int, str], model: DensityModel, space_weather: DataFrame) -> dict[int, tuple[int | None, float, str | None]]:
    """(rows, seconds, error) of each file, all read, evaluated and written by one job for each set of columns.

    Tasks first read all footers, so a file that isn't there, is broken or empty is known before the job.  In the job a
    row goes with its file's number, and is written below it; a file that the model failed on is left out.  The
    others' folders are then renamed to their places."""
    numbers = spark.createDataFrame(list(sources.items()), "number int, source string")
    tasks = max(1, min(len(sources), 4 * spark.sparkContext.defaultParallelism))
    found = numbers.repartition(tasks).mapInPandas(_footer, _FOOTERS).collect()
    out: dict[int, tuple[int | None, float, str | None]] = {r["number"]: (None, 0.0, r["error"]) for r in found if r["error"]}
    kinds: dict[str, list] = {}
    for r in found:
        if r["number"] not in out:
            kinds.setdefault(r["columns"], []).append((re.sub("^file:/+", "/", r["path"]), r["number"]))
    mixed = {n for n in sources if sum(n in {m for _, m in files} for files in kinds.values()) > 1}
    out |= {n: (None, 0.0, "the files of the table have different columns") for n in mixed}
    folder = next(iter(outputs.values())).rstrip("/").rpartition("/")[0]
    stage = f"{folder}/.generated-{uuid.uuid4().hex}"
    store = Store(spark, stage)
    told = spark.sparkContext.accumulator({}, _Told())
    try:
        for files in kinds.values():
            files = [f for f in files if f[1] not in mixed]
            if not files:
                continue
            known = spark.createDataFrame(files, "_path string, _number int")
            rows = spark.read.parquet(*[p for p, _ in files]).withColumn("_path", plain_path(F.col("_metadata.file_path")))
            rows = rows.join(F.broadcast(known) if len(files) <= BROADCAST_FILES else known, "_path").drop("_path")
            made = densities_by_file(with_forcing(rows, space_weather), model, "_number", lambda n, error, s: told.add({n: (error, s)}))
            made.write.mode("append").option("compression", "lz4").partitionBy("_number", "_failed").parquet(stage)
        if not kinds or all(n in out for n in sources):
            return out
        counts = spark.read.parquet(stage).groupBy("_number", "_failed").count().collect()
        failed = {r["_number"] for r in counts if str(r["_failed"]) == "true"}
        whole = {r["_number"]: r["count"] for r in counts if r["_number"] not in failed}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: put(spark, f"{stage}/_number={n}/_failed=false", outputs[n]), whole))
        for n in sources:
            if n not in out:
                error, seconds = told.value.get(n, (None, 0.0))
                out[n] = (whole.get(n), seconds, None if n in whole else error or "no rows were made")
        return out
    finally:
        store.delete()


def generate(
    spark: SparkSession,
    sources: str | Sequence[str],
    model: DensityModel,
    space_weather: DataFrame,
    manifest: str | None = None,
    resume: bool = True,
    skip_existing: bool = True,
    batch: int = BATCH,
    at_once: int = 10_000,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC),
) -> DataFrame:
    """A row per file as in ``RUN_MANIFEST``: success, failed (with the error) or skipped.

    Up to ``at_once`` files are one plan, however small they are: tasks take their rows together, in batches of ``batch``, and
    a file that can't be read, or that the model fails on, doesn't stop the others.  When a plan ends, its files' rows are
    appended to ``manifest``, so a run that is stopped goes on with the plan where it was.  If a plan itself fails, as by a file
    whose pages are broken behind a good footer, its files are done one by one.  A file's elapsed_s are the
    seconds that the model took for its rows, over all tasks.  A single path, given as a string, raises its error after it is
    logged."""
    alone = isinstance(sources, str)
    files = spark.createDataFrame([(s,) for s in ([sources] if alone else sources)], "source_file string").select("source_file", renamed(F.col("source_file"), "merged", "msis").alias("output_file"))
    runs = read_csv(spark, manifest, RUN_MANIFEST) if manifest is not None else None
    todo, skipped = pending(files, runs, existing(spark, files), resume, skip_existing)
    todo, skipped = todo.orderBy("source_file").collect(), skipped.collect()
    stamp = lambda: now().strftime("%Y-%m-%dT%H:%M:%SZ")

    def logged(rows: list[tuple]) -> list[tuple]:
        if manifest is not None and rows:
            append_csv(spark.createDataFrame(rows, RUN_MANIFEST), manifest, RUN_MANIFEST)
        return rows

    def run(part: dict[int, tuple[str, str]]) -> list[tuple]:
        source, output = {i: s for i, (s, _) in part.items()}, {i: o for i, (_, o) in part.items()}
        try:
            found = _one_plan(spark, source, output, model, space_weather)
        except Exception as error:  # of the plan as a whole
            if len(part) > 1:
                return [row for i, pair in part.items() for row in run({i: pair})]
            found = {i: (None, 0.0, str(error)[:240]) for i in part}
        rows = []
        for i, (n, seconds, error) in sorted(found.items()):
            rows.append((stamp(), "failed" if error else "success", source[i], output[i], i, n, None if n is None else -(-n // batch), round(seconds, 3), batch, 1, error))
        return logged(rows)

    log = logged([(stamp(), "skipped", r["source_file"], r["output_file"], None, None, None, None, batch, 1, r["reason"]) for r in skipped])
    pairs = {i: (r["source_file"], r["output_file"]) for i, r in enumerate(todo, 1)}
    with batches_of(spark, batch):
        for a in range(0, len(pairs), at_once):
            log += run({i: pairs[i] for i in list(pairs)[a : a + at_once]})
    if alone:
        for row in log:
            if row[1] == "failed":
                raise ValueError(row[-1])
    return spark.createDataFrame(log, RUN_MANIFEST)
