"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few fixed-width columns is broadcast (about 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes, about, of what rows of any width hold up to which their table is broadcast.
BROADCAST_BYTES = 8 << 20
#: Rows, and bytes, of an Arrow batch in place of Spark's defaults: whole texts are long, and a batch is held in several
#: copies, by the executor and by Python.  A longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 2000, 2 << 20

#: Java and Python pattern of one word: a run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Sends whole texts to Python in batches of ``ARROW_ROWS`` and about ``ARROW_BYTES``, unless the session has sizes of
    its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, that gives freed memory back to the system when the task ends: Python
    workers live on and are reused, and what they hold counts beside the next tasks'."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or, only where that is unset
    and the master is local, as in a test, a temporary one.  On a cluster without it, an error: executors would write to
    disks of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orbiteer-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but a table of Parquet.  For loops: what Spark infers of a checkpointed plan's columns is kept
    with it and grows from turn to turn; of a table it knows nothing.  Its files stay until ``discard``, or, as those of
    checkpoints, until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows of fixed width, else as it is (a shuffle join).

    Counts ``df``, so give a checkpointed one."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fits(df: DataFrame, size: Column, rows: int = BROADCAST_ROWS, total: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, checkpointed, has at most so many rows, of which ``size`` adds up to at most ``total``."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= total
