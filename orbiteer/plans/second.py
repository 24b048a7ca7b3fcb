"""The second branch's table: its own flux columns and density, under the names that it writes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import DensityModel
from ..operators.ratios import MANGLED
from ..operators.weather import ap_history, attach_daily, centred_mean, slot_of, with_day
from ..schemas import ALTITUDE, LATITUDE, LONGITUDE
from ..sources.tables import scan, write

#: The branch has one version of the model.
VERSION = "2.0"


def with_flux(rows: DataFrame, space_weather: DataFrame) -> DataFrame:
    """``rows`` with matlab_f107_daily (the flux of the day before), matlab_f107_81day_avg (the mean of the 81 days around,
    computed from the daily flux) and the history of geomagnetic indices (aps)."""
    daily = centred_mean(with_day(space_weather), "F107_OBS")
    rows = attach_daily(rows, daily.select("date", F.col("F107_OBS").alias("matlab_f107_daily")), lag_days=1)
    rows = attach_daily(rows, daily.select("date", F.col("F107_OBS_81day_avg").alias("matlab_f107_81day_avg")))
    history = ap_history(space_weather)
    return rows.join(history, slot_of() == history["slot"], "left").drop("slot")


def second_table(rows: DataFrame, space_weather: DataFrame, model: DensityModel) -> DataFrame:
    """``rows`` (timestamp, position and any others) with the flux columns and matlab_density, by a model given from outside."""
    rows = with_flux(rows, space_weather)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "aps"], T.StructField("matlab_density", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            aps = np.array([x if x is not None else [np.nan] * 7 for x in part["aps"]], dtype=float).reshape(-1, 7)
            where = part["timestamp"].to_numpy(), part[LONGITUDE].to_numpy(), part[LATITUDE].to_numpy(), part[ALTITUDE].to_numpy() / 1000.0
            flux = part["matlab_f107_daily"].to_numpy(dtype=float), part["matlab_f107_81day_avg"].to_numpy(dtype=float)
            made = np.asarray(model(*where, *flux, aps, version=VERSION), dtype=float).reshape(len(part)) if len(part) else []
            yield part.drop(columns="aps").assign(matlab_density=made)[schema.names]

    return rows.mapInPandas(run, schema)


def mangled(df: DataFrame) -> DataFrame:
    """``df`` with the names that the second branch writes; ``ratios.restored`` puts back the others."""
    return df.withColumnsRenamed({ours: theirs for theirs, ours in MANGLED.items() if ours in df.columns})


def write_second(spark: SparkSession, source: str, out: str, space_weather: DataFrame, model: DensityModel) -> None:
    """Writes the second branch's table of a merged one."""
    write(mangled(second_table(scan(spark, source), space_weather, model)), out)
