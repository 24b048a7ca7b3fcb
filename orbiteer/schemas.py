"""Schemas of the tables, and what is known of each mission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_D, _S = T.DoubleType(), T.StringType()

# Column names as the published files have them, spelling included.
DATE, TIME, TIME_SYSTEM = "Date yyyy-mm-dd", "Time hh:mm:ss.sss", "Time System"
ALTITUDE, LONGITUDE, LATITUDE = "Altitude (m)", "Longitude (deg)", "Latitude (deg)"
LOCAL_TIME, DENSITY = "Local Solar Time (hours)", "Density (kg/m^3)"
ANOMALOUS, DEGRADED = "Anomalus Density (kg/m^3)", "Degraded Flag Thrusters"

#: Raw mission text; the time of day stays text until it is joined to the date.
ACCELEROMETER = _schema(
    (DATE, T.DateType()),
    (TIME, _S),
    (TIME_SYSTEM, _S),
    (ALTITUDE, _D),
    (LONGITUDE, _D),
    (LATITUDE, _D),
    (LOCAL_TIME, _D),
    ("Argument of Latitude (deg)", _D),
    (DENSITY, _D),
    ("Density Mean (kg/m^3)", _D),
    (ANOMALOUS, _D),
    ("Anomalus Density Mean (kg/m^3)", _D),
)
SCHEMAS = {name: ACCELEROMETER for name in ("CHAMP", "GRACE", "GRACE_FO", "SWARM")}
SCHEMAS["GOCE"] = T.StructType([*ACCELEROMETER.fields, T.StructField(DEGRADED, _D)])

#: Raw archive text.
ARCHIVE = _schema(("YYYYMMDDhhmm", _S), ("JulianDay", _D), ("HTM", _D), ("LAT", _D), ("LON", _D), ("LST", _D), ("RHO", _D))

SPACE_WEATHER = _schema(
    ("YEAR", T.IntegerType()),
    ("MONTH", T.IntegerType()),
    ("DAY", T.IntegerType()),
    *[(f"AP{i}", _D) for i in range(1, 9)],
    ("AP_AVG", _D),
    ("F107_OBS", _D),
    ("F107_OBS_CENTER81", _D),
    ("F107_DATA_TYPE", _S),
)

DECODE_MANIFEST = _schema(("mission", _S), ("mission_code", _S), ("parquet_path", _S), ("source_path", _S))
MERGE_MANIFEST = _schema(("mission_code", _S), ("parquet_path", _S))
RUN_MANIFEST = _schema(
    ("finished_at_utc", _S),
    ("status", _S),
    ("source_file", _S),
    ("output_file", _S),
    ("file_index", T.LongType()),
    ("rows", T.LongType()),
    ("batches", T.LongType()),
    ("elapsed_s", _D),
    ("batch_size", T.LongType()),
    ("inner_threads", T.LongType()),
    ("error", _S),
)
DOWNLOAD_ENTRY = _schema(("path", _S), ("url", _S), ("status", _S), ("timestamp", _S), ("size_bytes", T.LongType()), ("error", _S))
DOWNLOAD_MANIFEST = T.StructType([T.StructField("dataset", _S), T.StructField("created_at", _S), T.StructField("entries", T.ArrayType(DOWNLOAD_ENTRY))])

#: The canonical short names of a density table, for those who prefer them.
SHORT_NAMES = {
    ALTITUDE: "altitude_m",
    LONGITUDE: "longitude_deg",
    LATITUDE: "latitude_deg",
    LOCAL_TIME: "local_solar_time_h",
    DENSITY: "density_kg_m3",
    ANOMALOUS: "anomalous_density_kg_m3",
    DEGRADED: "degraded_thrusters",
}

VERSIONS = ("0", "2.0", "2.1")
METRICS = ("ln_density_ratio_0", "ln_density_ratio_2.0", "ln_density_ratio_matlab_density")


@dataclass(frozen=True)
class Mission:
    """What selects a mission's rows: an altitude band in km, and the flag columns that must be 0."""

    name: str
    altitude_km: tuple[float, float]
    flags: tuple[str, ...]
    years_out: bool = False


MISSIONS = {
    "CHAMP": Mission("CHAMP", (300.0, 500.0), (ANOMALOUS,), years_out=True),
    "GOCE": Mission("GOCE", (225.0, 300.0), (ANOMALOUS, DEGRADED)),
}
