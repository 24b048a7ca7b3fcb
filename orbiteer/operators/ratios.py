"""The analysed table: model and second-branch densities beside the observed one, as log ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c, log_ratio
from ..schemas import ALTITUDE, DENSITY, LATITUDE, LOCAL_TIME, LONGITUDE, VERSIONS

#: Names as the second branch writes them, and ours.
MANGLED = {"Altitude_m_": ALTITUDE, "Latitude_deg_": LATITUDE, "Longitude_deg_": LONGITUDE, "LocalSolarTime_hours_": LOCAL_TIME, "Density_kg_m_3_": DENSITY}


def restored(second: DataFrame) -> DataFrame:
    """The second branch's table with the names of the first."""
    return second.withColumnsRenamed({k: v for k, v in MANGLED.items() if k in second.columns})


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, if no two rows share ``keys``: a join on them would multiply rows."""
    if not df.groupBy(*[c(k) for k in keys]).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat {', '.join(keys)}")
    return df


def with_log_ratios(df: DataFrame, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """ln_density_ratio_<version>, and ln_density_ratio_matlab_density, for the densities there are."""
    made = {f"ln_density_ratio_{v}": f"msis_density_{v}" for v in versions} | {"ln_density_ratio_matlab_density": "matlab_density"}
    return df.withColumns({ratio: log_ratio(c(model), c(DENSITY)) for ratio, model in made.items() if model in df.columns})


def analysed(model: DataFrame, second: DataFrame | None = None, keys: Sequence[str] = ("mission", "timestamp")) -> DataFrame:
    """The model's output with log ratios, and the second branch's density for the same mission and time, if given."""
    if second is not None:
        extra = [x for x in second.columns if x.startswith("matlab_")]
        right = assert_unique(restored(second).select(*[c(x) for x in (*keys, *extra)]), keys)
        model = model.join(right, list(keys), "left")
    return with_log_ratios(model)


def write_bucketed(df: DataFrame, table: str, buckets: int = 64, keys: Sequence[str] = ("mission", "timestamp")) -> None:
    """Saves ``df`` as a table whose files are dealt by a hash of ``keys`` and sorted by them: tables with as many buckets join
    on these keys bucket by bucket, without moving or sorting a row again.  One shuffle here deals the rows as the files are."""
    dealt = df.repartition(buckets, *[c(k) for k in keys])
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def analysed_tables(spark: SparkSession, model: str, second: str | None = None, keys: Sequence[str] = ("mission", "timestamp")) -> DataFrame:
    """``analysed`` of tables by name, as ``write_bucketed`` saves them."""
    return analysed(spark.table(model), spark.table(second) if second is not None else None, keys)


def with_mission(frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of several missions, with their names; columns that a mission lacks are null."""
    out = None
    for name, frame in frames.items():
        frame = frame.withColumn("mission", F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        raise ValueError("no missions given")
    return out
