"""Putting a mission's decoded tables together on one time line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c
from ..functions.time import compose
from ..schemas import DATE, TIME, TIME_SYSTEM


def strict_union(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames, whose columns must have the same names and types in the same order."""
    if not frames:
        raise ValueError("nothing to put together")
    for i, frame in enumerate(frames[1:], 2):
        if frame.dtypes != frames[0].dtypes:
            raise ValueError(f"table {i} has other columns than the first: {sorted(set(frame.dtypes) ^ set(frames[0].dtypes))}")
    return reduce(DataFrame.unionByName, frames)


def collapse_constant(df: DataFrame, column: str) -> DataFrame:
    """``df`` without ``column`` if it has one value throughout (null is a value)."""
    if column not in df.columns:
        return df
    x = c(column)
    lacking, least, most = F.max(x.isNull()), F.min(x), F.max(x)
    one = df.agg(F.coalesce(F.when(lacking, least.isNull()).otherwise(least == most), F.lit(False)).alias("one")).first()["one"]
    return df.drop(x) if one else df


def merge(frames: list[DataFrame]) -> DataFrame:
    """A mission's rows with one timestamp instead of date and time, by time; the time system goes if there is one only."""
    df = collapse_constant(strict_union(frames), TIME_SYSTEM)
    if DATE in df.columns and TIME in df.columns:
        df = df.withColumn("timestamp", compose(c(DATE), c(TIME))).drop(c(DATE), c(TIME))
    return df.orderBy("timestamp") if "timestamp" in df.columns else df
