"""Seasonal statistics of log density ratios by mission, solar activity and bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NAN, c, n_unique, safe_div, std_or_zero
from ..functions.time import bin_midpoint, date_bin, flux_bucket, seasonal_bin
from ..schemas import ALTITUDE

MODES = ("uncertainty_of_mean", "raw_observation_uncertainty", "paper", "sample_std")


def with_bins(df: DataFrame, ts: str = "timestamp", f107a: str = "f107a") -> DataFrame:
    """``df`` with seasonal_bin, date_bin and bucket."""
    return df.withColumns({"seasonal_bin": seasonal_bin(c(ts)), "date_bin": date_bin(c(ts)), "bucket": flux_bucket(c(f107a))})


def metric_columns(df: DataFrame, metrics: Mapping[str, str], optional: Sequence[str] = ()) -> dict[str, str]:
    """alias -> column for the metrics there are; a missing one raises unless it is optional."""
    missing = [name for alias, name in metrics.items() if name not in df.columns and alias not in optional]
    if missing:
        raise ValueError(f"no such metric: {', '.join(missing)}")
    return {alias: name for alias, name in metrics.items() if name in df.columns}


def daily_means(binned: DataFrame, metrics: Mapping[str, str], keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """The mean of each metric for each day, bin and key."""
    return binned.groupBy(*keys, "seasonal_bin", "date_bin").agg(*[F.avg(c(name)).alias(alias) for alias, name in metrics.items()])


def _sem(x: Column) -> Column:
    """Standard error of the mean; NaN where there is no value."""
    return F.when(F.count(x) == 0, F.lit(NAN)).otherwise(std_or_zero(x) / F.sqrt(F.when(F.count(x) > 0, F.count(x))))


def figure_bins(binned: DataFrame, metrics: Mapping[str, str], mode: str, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """For each of ``keys`` and seasonal_bin: <alias>_mean and <alias>_std of every metric, and count.

    uncertainty_of_mean: of daily means, with their standard error; count is days with a first metric.
    raw_observation_uncertainty: of observations, their deviation over the root of the number of days.
    paper: of observations, with the root of mean square less squared mean (NaN where rounding makes that negative).
    sample_std: of observations, with their sample deviation.
    Rows without a bucket are in no group; bins without rows are absent."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    rows = binned.where(F.col("bucket").isNotNull()) if "bucket" in keys else binned
    first, days = next(iter(metrics)), F.col("date_bin")
    if mode == "uncertainty_of_mean":
        rows = daily_means(rows, metrics, keys)
        value = {alias: F.col(alias) for alias in metrics}
        spread = _sem
    else:
        value = {alias: c(name) for alias, name in metrics.items()}
        spread = {
            "raw_observation_uncertainty": lambda x: safe_div(std_or_zero(x), F.sqrt(n_unique(days))),
            "paper": lambda x: F.sqrt(F.avg(x * x) - F.avg(x) * F.avg(x)),
            "sample_std": std_or_zero,
        }[mode]
    columns = [f(x).alias(f"{alias}_{kind}") for alias, x in value.items() for kind, f in (("mean", F.avg), ("std", spread))]
    return rows.groupBy(*keys, "seasonal_bin").agg(*columns, F.count(value[first]).alias("count"))


def with_midpoint(bins: DataFrame) -> DataFrame:
    return bins.withColumn("day_of_year", bin_midpoint(F.col("seasonal_bin")))


def _derived(stats: DataFrame) -> DataFrame:
    over_days = F.when(F.col("unique_days") > 0, F.col("x_raw_std") / F.sqrt(F.when(F.col("unique_days") > 0, F.col("unique_days"))))
    return stats.withColumn("x_raw_std_over_sqrt_days", over_days)


def bin_stats_joined(binned: DataFrame, metric: str, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """``bin_stats`` as a join of raw and daily statistics, which reads the rows twice."""
    keys, x = [*keys, "seasonal_bin"], c(metric)
    raw = binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), n_unique(F.col("date_bin")).alias("unique_days"), F.avg(x).alias("x_mean"), F.stddev_samp(x).alias("x_raw_std")
    )
    daily = binned.groupBy(*keys, "date_bin").agg(F.avg(x).alias("x"))
    daily = daily.groupBy(*keys).agg(F.avg("x").alias("x_daily_mean"), _sem(F.col("x")).alias("x_daily_mean_sem"))
    return _derived(raw.join(daily, keys))


def bin_stats(binned: DataFrame, metric: str, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """For each of ``keys`` and seasonal_bin: rows, unique_days, mean and sample deviation of the observations (null for
    one), mean of daily means and its standard error, and the deviation over the root of the number of days.

    One pass: days carry count, mean and squared deviations, from which the raw figures follow, so rows are read and
    shuffled once and, after the first step, as days."""
    keys, x = [*keys, "seasonal_bin"], c(metric)
    days = binned.groupBy(*keys, "date_bin").agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("x"), F.var_pop(x).alias("v"))
    weight, of_means = F.sum("n"), F.sum(F.col("n") * F.col("x"))
    stats = days.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        n_unique(F.col("date_bin")).alias("unique_days"),
        weight.alias("n"),
        F.when(weight > 0, of_means / F.when(weight > 0, weight)).alias("x_mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        # squared deviations of the days' means, from a mean near them, which keeps their digits
        F.avg("x").alias("x_daily_mean"),
        F.collect_list(F.struct("n", "x")).alias("days"),
        _sem(F.col("x")).alias("x_daily_mean_sem"),
    )
    between = F.aggregate("days", F.lit(0.0), lambda s, d: s + F.coalesce(d["n"] * (d["x"] - F.col("x_mean")) * (d["x"] - F.col("x_mean")), F.lit(0.0)))
    deviation = F.when(F.col("n") > 1, F.sqrt((F.col("within") + between) / F.when(F.col("n") > 1, F.col("n") - 1)))
    stats = stats.withColumn("x_raw_std", deviation).drop("n", "within", "days")
    return _derived(stats).select(*keys, "rows", "unique_days", "x_mean", "x_raw_std", "x_daily_mean", "x_daily_mean_sem", "x_raw_std_over_sqrt_days")


def printed(stats: DataFrame, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """The columns of the printed table."""
    return stats.select(
        *keys,
        F.col("seasonal_bin").alias("bin"),
        "rows",
        F.col("unique_days").alias("days"),
        F.col("x_mean").alias("raw_mean"),
        F.col("x_daily_mean").alias("daily_mean"),
        F.col("x_daily_mean_sem").alias("daily_sem"),
        F.col("x_raw_std_over_sqrt_days").alias("raw_sem"),
        F.col("x_raw_std").alias("raw_std"),
    )


def maxima(stats: DataFrame, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """The largest of each kind of uncertainty over a key's bins."""
    names = {"max_daily_mean_sem": "x_daily_mean_sem", "max_raw_std_over_sqrt_days": "x_raw_std_over_sqrt_days", "max_raw_std": "x_raw_std"}
    return stats.groupBy(*keys).agg(*[F.max(x).alias(name) for name, x in names.items()])


def mission_summary(df: DataFrame, ts: str = "timestamp", altitude: str = ALTITUDE, keys: Sequence[str] = ()) -> DataFrame:
    """rows, unique_days, start, end, min_alt_km and max_alt_km, of all rows or of each key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        n_unique(date_bin(c(ts))).alias("unique_days"),
        F.min(c(ts)).alias("start"),
        F.max(c(ts)).alias("end"),
        (F.min(c(altitude)) / 1000.0).alias("min_alt_km"),
        (F.max(c(altitude)) / 1000.0).alias("max_alt_km"),
    )
