"""Row filters: altitude bands, excluded years, quality flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import all_of, c
from ..schemas import ALTITUDE, MISSIONS


def altitude_band(metres: Column, low_km: float, high_km: float) -> Column:
    """metres / 1000 between both ends.  The division can't reach the scan, so a slightly wider range of metres, which
    can, goes with it."""
    wide = metres.between(low_km * 1000 * (1 - 1e-9), high_km * 1000 * (1 + 1e-9))
    return wide & (metres / 1000.0).between(low_km, high_km)


def excluded_years(ts: Column, with_2005: bool) -> Column:
    """From 2001 on, without 2006 (or 2005) to 2009.  The last excluded time is the first instant of 2009-12-31."""
    start = dt.datetime(2005 if with_2005 else 2006, 1, 1)
    stamp = lambda t: F.lit(t.isoformat(" ")).cast("timestamp_ntz")
    return (ts >= stamp(dt.datetime(2001, 1, 1))) & ((ts < stamp(start)) | (ts > stamp(dt.datetime(2009, 12, 31))))


def no_flags(flags: list[Column]) -> Column:
    return all_of([f == 0 for f in flags])


def mission_filter(name: str, exclude_2005: bool = False) -> Column:
    """The rows of a mission's analysed table that count; an unknown mission raises."""
    if name not in MISSIONS:
        raise ValueError(f"unknown mission {name!r}; known: {', '.join(MISSIONS)}")
    mission = MISSIONS[name]
    conditions = [altitude_band(c(ALTITUDE), *mission.altitude_km), no_flags([c(f) for f in mission.flags])]
    if mission.years_out:
        conditions.append(excluded_years(c("timestamp"), exclude_2005))
    return all_of(conditions)


def date_slice(df: DataFrame, day: Column, first: Column, last: Column) -> DataFrame:
    """Rows whose ``day`` is between ``first`` and ``last``, both included; raises if there are none."""
    out = df.where(day.between(first, last))
    if out.isEmpty():
        raise ValueError("no rows in this range of days")
    return out


def require_rows(df: DataFrame, columns: int) -> DataFrame:
    """``df``, if it has rows and at least so many columns."""
    if len(df.columns) < columns or df.isEmpty():
        raise ValueError(f"expected rows of at least {columns} columns")
    return df
