"""Tables whose files lie by mission and month, so filters on either read no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c
from ..functions.time import month_key


def write_by_month(df: DataFrame, path: str, ts: str = "timestamp", keys: Sequence[str] = ("mission",), compression: str = "snappy") -> None:
    """Writes ``df`` with a column ``month`` (YYYY-MM of ``ts``), its files by ``keys`` and month.  Rows of one folder are brought
    together before, so it gets few files; a mission or month with most rows is dealt to several tasks."""
    rows = df.withColumn("month", month_key(c(ts)))
    rows.hint("rebalance", *keys, "month").write.mode("overwrite").option("compression", compression).partitionBy(*keys, "month").parquet(path)


def months_between(table: DataFrame, first: str, last: str) -> DataFrame:
    """The rows of the months from ``first`` to ``last`` (YYYY-MM, both included); other months' files aren't opened."""
    return table.where(F.col("month").between(first, last))


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
