"""Solar flux and geomagnetic indices: repair, slices and lookups by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import c
from ..functions.time import hour_key, month_key, padded
from .filters import date_slice

#: A daily flux above this is taken for an outlier.
HIGH_FLUX = 400.0
_KEPT = ("YEAR", "MONTH", "DAY", *[f"AP{i}" for i in range(1, 9)], "AP_AVG", "F107_OBS", "F107_DATA_TYPE", "F107_OBS_CENTER81")


def replace_high_flux(daily: DataFrame, limit: float = HIGH_FLUX) -> DataFrame:
    """Daily flux above ``limit`` becomes the 81-day mean, and its type INT."""
    high = F.col("F107_OBS") > limit
    return daily.withColumns({
        "F107_OBS": F.when(high, F.col("F107_OBS_CENTER81")).otherwise(F.col("F107_OBS")),
        "F107_DATA_TYPE": F.when(high, F.lit("INT")).otherwise(F.col("F107_DATA_TYPE")),
    })


def pruned(daily: DataFrame) -> DataFrame:
    """The columns that lookups use."""
    return daily.select(*[name for name in _KEPT if name in daily.columns])


def with_day(daily: DataFrame) -> DataFrame:
    return daily.withColumn("date", F.make_date("YEAR", "MONTH", "DAY"))


def slice_around(daily: DataFrame, times: DataFrame, ts: str = "timestamp", before: int = 3, after: int = 1) -> DataFrame:
    """The days of ``daily`` (with date) from ``before`` days ahead of the first of ``times`` to ``after`` beyond the last;
    raises if there are none."""
    limits = times.agg(F.min(c(ts)).alias("start"), F.max(c(ts)).alias("end"))
    first, last = padded(F.col("start"), F.col("end"), before, after)
    limits = limits.select(first.alias("first_day"), last.alias("last_day")).first()
    return date_slice(daily, F.col("date"), F.lit(limits["first_day"]), F.lit(limits["last_day"]))


def slice_by_month(daily: DataFrame, times: DataFrame, ts: str = "timestamp", day: str = "date", before: int = 3, after: int = 1) -> DataFrame:
    """As ``slice_around``, of a table with a column ``month`` by which its files lie (``sources.layout``).  The range stays in
    the plan: a join with its few months prunes the files of all others when the query runs."""
    limits = times.agg(F.min(c(ts)).alias("start"), F.max(c(ts)).alias("end"))
    first, last = padded(F.col("start"), F.col("end"), before, after)
    limits = limits.select(first.alias("_first"), last.alias("_last")).where("_first <= _last")
    months = limits.select("*", F.explode(F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"), F.expr("interval 1 month"))).alias("_month"))
    months = months.select("_first", "_last", month_key(F.col("_month")).alias("month"))
    out = daily.join(F.broadcast(months), "month").where(c(day).between(F.col("_first"), F.col("_last")))
    if out.isEmpty():
        raise ValueError("no rows in this range of days")
    return out.drop("_first", "_last")


def with_halo(df: DataFrame, at: Column, before: int, after: int, size: int) -> DataFrame:
    """``df`` with _part, the stretch of ``size`` steps that a row of position ``at`` (an integer) is in, and copies of the
    rows at its edges in the stretches beside it (_copy), so a window over up to ``before`` steps back and ``after`` ahead finds all it
    needs in one stretch, and stretches are windows of their own.  Rows without a position are a stretch."""
    part = lambda x: F.floor(x / F.lit(size))
    rows = df.withColumn("_part", F.explode_outer(F.sequence(part(at - after), part(at + before))))
    return rows.withColumn("_copy", ~F.col("_part").eqNullSafe(part(at)))


def centred_mean(daily: DataFrame, value: str, day: str = "date", days: int = 81, stretch: int = 730) -> DataFrame:
    """``daily`` with the mean of ``value`` over the days around each, by the calendar, so gaps don't shift it.

    Days are dealt out in stretches with ``days`` // 2 more on either side: no task has to hold them all."""
    half, at = days // 2, F.unix_date(c(day))
    around = Window.partitionBy("_part").orderBy(at).rangeBetween(-half, half)
    rows = with_halo(daily, at, half, half, stretch).withColumn(f"{value}_{days}day_avg", F.avg(c(value)).over(around))
    return rows.where(~F.col("_copy")).drop("_part", "_copy")


def attach_daily(rows: DataFrame, daily: DataFrame, ts: str = "timestamp", lag_days: int = 0) -> DataFrame:
    """``rows`` with the columns of ``daily`` for their day (less ``lag_days``); rows without one get nulls.  Spark
    broadcasts the daily table if it is below its limit, as any real one is, and shuffles by day otherwise.  Days that
    repeat raise an error: they would multiply rows."""
    values = [x for x in daily.columns if x != "date"]
    days = daily.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c(x)).alias(x) for x in values])
    once = lambda x: F.when(F.col("_n") == 1, c(x)).otherwise(F.raise_error(F.lit("a day repeats in the daily table"))).alias(x)
    daily = days.select("date", *[once(x) for x in values])
    key = F.date_sub(F.to_date(c(ts)), lag_days)
    return rows.join(daily.withColumnRenamed("date", "_date"), key == F.col("_date"), "left").drop("_date")


def three_hourly(daily: DataFrame) -> DataFrame:
    """(slot, ap): one row for each three hours, the slot being its number since 1970."""
    stacked = F.expr("stack(8, " + ", ".join(f"{i}, AP{i + 1}" for i in range(8)) + ") as (i, ap)")
    return with_day(daily).select("date", "AP_AVG", stacked).select((F.unix_date("date").cast("long") * 8 + F.col("i")).alias("slot"), "ap", F.col("AP_AVG").alias("ap_day"))


def ap_history(daily: DataFrame, stretch: int = 8 * 365) -> DataFrame:
    """(slot, aps): daily mean; the three hours' value; those 3, 6 and 9 hours before; the means of the eight values 12
    to 33 and 36 to 57 hours before.  Slots are dealt out in stretches with the 19 before each."""
    over = Window.partitionBy("_part").orderBy("slot")
    at = lambda a, b: F.avg("ap").over(over.rangeBetween(a, b))
    aps = F.array("ap_day", "ap", at(-1, -1), at(-2, -2), at(-3, -3), at(-11, -4), at(-19, -12)).alias("aps")
    return with_halo(three_hourly(daily), F.col("slot"), 19, 0, stretch).select("slot", aps, "_copy").where(~F.col("_copy")).drop("_copy")


def slot_of(ts: str = "timestamp"):
    day = F.unix_date(F.to_date(c(ts))).cast("long")
    return day * 8 + F.floor(F.hour(c(ts)) / 3)


def lookup_by_hour(rows: DataFrame, lookup: Callable[[DataFrame], DataFrame], ts: str = "timestamp") -> DataFrame:
    """``rows`` with the columns that ``lookup`` adds to a table of their different hours (hour), which it sees once each.

    Catalyst doesn't do this by itself: the hours are made distinct first, the costly function runs on those alone, and
    an equi-join brings its columns back.  A null time is an hour of its own."""
    keyed = rows.withColumn("_hour", hour_key(c(ts)))
    found = lookup(keyed.select(F.col("_hour").alias("hour")).distinct())
    return keyed.join(found, keyed["_hour"].eqNullSafe(found["hour"]), "left").drop("_hour", "hour")
