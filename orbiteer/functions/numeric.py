"""Column functions with the arithmetic of IEEE doubles, where Spark's own would raise or give null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def c(name: str) -> Column:
    """The column of that name, whatever characters it has (dots too)."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_log(x: Column) -> Column:
    """ln x; minus infinity at 0 and NaN below."""
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as doubles: infinite or NaN where b is 0."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def clip(x: Column, low: float, high: float) -> Column:
    """x, but at least ``low`` and at most ``high``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log_ratio(model: Column, observed: Column) -> Column:
    """ln(model / observed)."""
    return safe_log(safe_div(model, observed))


def n_unique(x: Column) -> Column:
    """Number of different values, null being one."""
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0))


def std_or_zero(x: Column) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
