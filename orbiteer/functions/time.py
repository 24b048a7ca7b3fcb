"""Dates, times and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip

BIN_DAYS, BINS = 30.5, 12
#: Limits of the 81-day mean solar flux between the buckets.
FLUX_LIMITS = (100.0, 160.0)
BUCKETS = ("<100", "100-160", ">=160")


def seasonal_bin(ts: Column) -> Column:
    """0 to 11: twelfths of the year of 30.5 days."""
    return clip(F.floor((F.dayofyear(ts) - 1) / F.lit(BIN_DAYS)), 0, BINS - 1).cast("long")


def bin_midpoint(bin_: Column) -> Column:
    """The day of the year in the middle of a bin."""
    return (bin_ + F.lit(0.5)) * F.lit(BIN_DAYS)


def date_bin(ts: Column) -> Column:
    return F.to_date(ts)


def flux_bucket(f107a: Column) -> Column:
    """The solar-activity bucket; a null is in none, NaN is above all limits."""
    low, high = FLUX_LIMITS
    return F.when(f107a < low, BUCKETS[0]).when(f107a < high, BUCKETS[1]).when(f107a.isNotNull(), BUCKETS[2])


def hour_key(ts: Column) -> Column:
    """The hour that a time is in (one hour, not three)."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def month_key(day: Column) -> Column:
    """The month that a day or time is in, as YYYY-MM."""
    return F.date_format(day, "yyyy-MM")


def second_of_day(ts: Column) -> Column:
    """Seconds since midnight, with their fraction."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_format(ts, "s.SSSSSS").cast("double")


def compose(date: Column, time: Column) -> Column:
    """A timestamp from a date and a time of day with up to six decimals, both as text or date; raises if malformed."""
    return F.concat(date.cast("string"), F.lit(" "), time).cast("timestamp_ntz")


def parse_compact(stamp: Column) -> Column:
    """A timestamp from yyyyMMddHHmm; raises if malformed."""
    return F.to_timestamp_ntz(stamp, F.lit("yyyyMMddHHmm"))


def now_iso() -> Column:
    """The time of the query in UTC, as ISO text to the second."""
    now = F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def padded(start: Column, end: Column, before: int, after: int) -> tuple[Column, Column]:
    """First and last day of a range of times, with days added on both sides."""
    return F.date_sub(F.to_date(start), before), F.date_add(F.to_date(end), after)


def month_spine(spark, start: str, end: str):
    """A row (ym, year, month) for each month from ``start`` to ``end`` (YYYY-MM, both included)."""
    (y0, m0), (y1, m1) = parse_month(start), parse_month(end)
    if (y0, m0) > (y1, m1):
        raise ValueError(f"{start} is after {end}")
    months = F.sequence(F.make_date(F.lit(y0), F.lit(m0), F.lit(1)), F.make_date(F.lit(y1), F.lit(m1), F.lit(1)), F.expr("interval 1 month"))
    days = spark.range(1).select(F.explode(months).alias("day"))
    return days.select(F.date_format("day", "yyyyMM").alias("ym"), F.year("day").alias("year"), F.month("day").alias("month"))


def parse_month(value: str) -> tuple[int, int]:
    """(year, month) of a strict YYYY-MM."""
    year, dash, month = value.strip().partition("-")
    if not (dash and len(year) == 4 and len(month) == 2 and (year + month).isascii() and (year + month).isdigit() and 1 <= int(month) <= 12):
        raise ValueError(f"not a month as YYYY-MM: {value!r}")
    return int(year), int(month)
