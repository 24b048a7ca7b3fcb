"""Daily means kept up to date as observations arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c


def daily_means(stream: DataFrame, metrics: Mapping[str, str], keys: Sequence[str] = (), late: str = "2 days", ts: str = "timestamp") -> DataFrame:
    """A streaming table of each day's mean of each metric; a day is final once the time has passed it by ``late``, and
    its state goes then."""
    days = F.window(F.col("_time"), "1 day")
    timed = stream.withColumn("_time", c(ts).cast("timestamp")).withWatermark("_time", late)
    means = timed.groupBy(*keys, days.alias("day")).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c(name)).alias(alias) for alias, name in metrics.items()])
    return means.withColumn("date_bin", F.to_date("day.start")).drop("day")
