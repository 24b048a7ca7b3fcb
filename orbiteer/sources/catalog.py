"""What can be fetched, and which files of a listing to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_component, in_months

# Addresses, file names and prefixes as the archives have them.
DENSITY_FOLDER = "https://thermosphere.tudelft.nl/data/data/version_02/"
MISSIONS = {
    "grace": (["GRACE_data/"], ["GA_DNS_ACC_", "GB_DNS_ACC_"], False),
    "grace_fo": (["GRACE-FO_data/"], ["GC_DNS_ACC_", "GD_DNS_ACC_"], False),
    "champ": (["CHAMP_data/"], ["CH_DNS_ACC_", "CHAMP_DNS_ACC_"], True),
    "swarm": (
        ["SWARM_data/", "Swarm_data/", "swarm_data/", "SWARM/"],
        ["SWA_DNS_ACC_", "SWB_DNS_ACC_", "SWC_DNS_ACC_", "SW_DNS_ACC_", "SA_DNS_POD_", "SB_DNS_POD_", "SC_DNS_POD_"],
        True,
    ),
    "goce": (["GOCE_data/", "Goce_data/", "goce_data/", "GOCE/"], ["GO_DNS_ACC_", "GOCE_DNS_ACC_"], True),
}
SPACE_WEATHER = {
    "SW-Last5Years.txt": "https://celestrak.org/SpaceData/SW-Last5Years.txt",
    "SW-All.txt": "https://celestrak.org/SpaceData/SW-All.txt",
    "f107_nrcan_daily.txt": "https://www.spaceweather.gc.ca/solar_flux_data/daily_flux_values/fluxtable.txt",
    "omni2_all_years.dat": "https://spdf.gsfc.nasa.gov/pub/data/omni/low_res_omni/omni2_all_years.dat",
}
CO2_FOLDER = "https://gml.noaa.gov/webdata/ccgg/trends/co2/"
CO2 = {
    "co2_mm_mlo.csv": "mauna_loa_monthly.csv",
    "co2_annmean_mlo.csv": "mauna_loa_annual.csv",
    "co2_weekly_mlo.csv": "mauna_loa_weekly.csv",
    "co2_daily_mlo.csv": "mauna_loa_daily.csv",
    "co2_gr_mlo.csv": "mauna_loa_growth_rate.csv",
    "co2_mm_gl.csv": "global_monthly.csv",
    "co2_annmean_gl.csv": "global_annual.csv",
    "co2_gr_gl.csv": "global_growth_rate.csv",
    "co2_trend_gl.csv": "global_trend.csv",
}
ARCHIVE = "https://sol.spacenvironment.net/Hasdm_database/download"
#: Months that the archive has, and the pause between its files in seconds.
ARCHIVE_MONTHS, ARCHIVE_PAUSE_S = ("2000-01", "2025-12"), 65.0


def sources(spark: SparkSession) -> DataFrame:
    """(dataset, name, url): the files with fixed addresses, and the listings of missions."""
    rows = [("space_weather", name, url) for name, url in SPACE_WEATHER.items()]
    rows += [("co2", local, CO2_FOLDER + remote) for remote, local in CO2.items()]
    rows += [(mission, "index", DENSITY_FOLDER + tail) for mission, (tails, _, _) in MISSIONS.items() for tail in tails]
    return spark.createDataFrame(rows, "dataset string, name string, url string")


def href_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """(name): the files that index pages link to, each once, in order."""
    names = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]+)"'), F.lit(1))).alias("name"))
    return names.where(~F.col("name").endswith("/")).distinct().orderBy("name")


def listing_names(text: DataFrame, column: str = "text") -> DataFrame:
    """(name): the lines of directory listings, trimmed, without empty ones."""
    return text.select(F.explode(F.split(column, "\n")).alias("line")).select(F.regexp_replace("line", r"^\s+|\s+$", "").alias("name")).where("name <> ''")


def _any_prefix(name: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | name.startswith(prefix)
    return out


def select_files(names: DataFrame, prefixes: list[str], start: int | None = None, end: int | None = None, fallback: bool = False) -> DataFrame:
    """The zip files of ``names`` with a prefix and a month in range; if there is none and ``fallback``, those with DNS in
    their names."""
    name = F.col("name")
    zips = names.where(name.endswith(".zip") & in_months(name, start, end)).withColumn("_own", _any_prefix(name, prefixes))
    if not fallback:
        return zips.where("_own").drop("_own")
    own = zips.where("_own")
    return (own if not own.isEmpty() else zips.where(F.contains(F.upper(name), F.lit("DNS")))).drop("_own")


def without_dirs(files: DataFrame, excluded: list[str], path: str = "path") -> DataFrame:
    """Files no component of whose path is one of ``excluded``; .csv files go too."""
    return files.where(~has_component(F.col(path), excluded) & ~F.col(path).endswith(".csv"))


def first_of(names: DataFrame, order: str = "name") -> DataFrame:
    return names.orderBy(order).limit(1)

