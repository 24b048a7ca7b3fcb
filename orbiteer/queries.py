"""Each operator as a query over the star-schema tables, which stand for observations, with its SQL.

A line item is an observation: its ship date the time, its quantity the solar flux, its prices the densities."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import time as T
from .functions.numeric import c, clip, log_ratio, n_unique
from .operators import binstats, filters, manifest, merge, model, ratios, weather
from .plans import decode, figure, generate, merge_sorted, second
from .schemas import ALTITUDE, DATE, DECODE_MANIFEST, DENSITY, LATITUDE, LOCAL_TIME, LONGITUDE, TIME
from .session import shared_folder
from .sources import archive, catalog, layout, tables
from .sources.commits import CommittedTable
from .sources.text import normalised

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; fewer are compared."""
    return df.select([F.round(c(n), digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def observations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    return rows.select(
        F.col("l_shipdate").alias("timestamp"),
        (F.lit(70.0) + 2.5 * (F.col("l_quantity") - 1)).alias("f107a"),
        log_ratio(1 + F.col("l_tax"), 1 - F.col("l_discount")).alias("ln_density_ratio_0"),
        log_ratio(F.col("l_extendedprice"), 900 * F.col("l_quantity")).alias("ln_density_ratio_2.0"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("Anomalus Density (kg/m^3)"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("Degraded Flag Thrusters"),
        (F.col("l_extendedprice") * 5.0).alias(ALTITUDE),
        F.col("l_linestatus").alias("mission"),
    )


OBS = """obs AS (SELECT l_shipdate AS ts, 70.0 + 2.5 * (l_quantity - 1) AS f107a, ln((1 + l_tax) / (1 - l_discount)) AS r0,
 ln(l_extendedprice / (900 * l_quantity)) AS r2, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS anomalous,
 CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS degraded, l_extendedprice * 5.0 AS altitude, l_linestatus AS mission FROM lineitem),
binned AS (SELECT *, CAST(least(greatest(floor((dayofyear(ts) - 1) / 30.5), 0), 11) AS BIGINT) AS seasonal_bin, CAST(ts AS DATE) AS date_bin,
 CASE WHEN f107a < 100 THEN '<100' WHEN f107a < 160 THEN '100-160' WHEN f107a IS NOT NULL THEN '>=160' END AS bucket FROM obs)"""
METRICS = {"msis_00": "ln_density_ratio_0", "msis_20": "ln_density_ratio_2.0"}
_DAILY = "daily AS (SELECT {k}, seasonal_bin, date_bin, avg(r0) AS r0, avg(r2) AS r2 FROM binned GROUP BY ALL)"
_SEM = "coalesce(stddev_samp({x}), 0) / sqrt(count({x}))"


def _figure_sql(source: str, spread: str, keys: str = "bucket") -> str:
    columns = ", ".join(f"round(avg({x}), 6) AS {a}_mean, round({spread.format(x=x)}, 6) AS {a}_std" for a, x in (("msis_00", "r0"), ("msis_20", "r2")))
    return f"WITH {OBS}, {_DAILY.format(k=keys)} SELECT {keys}, seasonal_bin, {columns}, count(r0) AS count FROM {source} GROUP BY {keys}, seasonal_bin"


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return binstats.with_bins(observations(spark, d))


@query(_figure_sql("daily", _SEM))
def fig_uncertainty_of_mean(spark, d):
    return rounded(binstats.figure_bins(_bins(spark, d), METRICS, "uncertainty_of_mean"))


@query(_figure_sql("binned", "coalesce(stddev_samp({x}), 0) / sqrt(count(DISTINCT date_bin))"))
def fig_raw_observation(spark, d):
    return rounded(binstats.figure_bins(_bins(spark, d), METRICS, "raw_observation_uncertainty"))


@query(_figure_sql("binned", "sqrt(avg({x} * {x}) - avg({x}) * avg({x}))"))
def fig_paper(spark, d):
    return rounded(binstats.figure_bins(_bins(spark, d), METRICS, "paper"))


@query(_figure_sql("binned", "coalesce(stddev_samp({x}), 0)"))
def fig_sample_std(spark, d):
    return rounded(binstats.figure_bins(_bins(spark, d), METRICS, "sample_std"))


@query(_figure_sql("daily", _SEM).replace("SELECT bucket, seasonal_bin, round", "SELECT bucket, seasonal_bin, (seasonal_bin + 0.5::DOUBLE) * 30.5::DOUBLE AS day_of_year, round"))
def fig_with_midpoint(spark, d):
    return rounded(binstats.with_midpoint(binstats.figure_bins(_bins(spark, d), METRICS, "uncertainty_of_mean")))


@query(_figure_sql("daily", _SEM, "mission, bucket").replace("bucket, seasonal_bin, round", "bucket, seasonal_bin, (seasonal_bin + 0.5::DOUBLE) * 30.5::DOUBLE AS day_of_year, round", 1))
def fig_multi_mission(spark, d):
    rows = observations(spark, d)
    missions = {m: rows.where(F.col("mission") == m).drop("mission") for m in ("O", "F")}
    return rounded(figure.figure_data(missions, metrics=METRICS, optional=())[0])


@query(f"""WITH {OBS} SELECT mission, mission || ' ' || round(min(altitude) / 1000)::BIGINT || '-' || round(max(altitude) / 1000)::BIGINT || ' km, ' || year(min(ts)) || '-' || year(max(ts)) AS label
FROM obs GROUP BY mission""")
def row_label(spark, d):
    rows = observations(spark, d)
    missions = {m: rows.where(F.col("mission") == m).drop("mission") for m in ("O", "F")}
    return figure.figure_data(missions, metrics=METRICS, optional=())[1]


@query(f"WITH {OBS}, {_DAILY.format(k='bucket')} SELECT bucket, seasonal_bin, date_bin, round(r0, 6) AS msis_00, round(r2, 6) AS msis_20 FROM daily")
def daily_means(spark, d):
    return rounded(binstats.daily_means(_bins(spark, d), METRICS))


_STATS = f"""WITH {OBS}, raw AS (SELECT bucket, seasonal_bin, count(*) AS rows, count(DISTINCT date_bin) AS unique_days, avg(r2) AS x_mean, stddev_samp(r2) AS x_raw_std
 FROM binned GROUP BY ALL), {_DAILY.format(k='bucket')}, means AS (SELECT bucket, seasonal_bin, avg(r2) AS x_daily_mean, {_SEM.format(x='r2')} AS x_daily_mean_sem FROM daily GROUP BY ALL),
stats AS (SELECT raw.*, x_daily_mean, x_daily_mean_sem, x_raw_std / sqrt(unique_days) AS x_raw_std_over_sqrt_days FROM raw JOIN means USING (bucket, seasonal_bin))"""
_STATS_ALL = _STATS + """ SELECT bucket, seasonal_bin, rows, unique_days, round(x_mean, 6) AS x_mean, round(x_raw_std, 6) AS x_raw_std, round(x_daily_mean, 6) AS x_daily_mean,
 round(x_daily_mean_sem, 6) AS x_daily_mean_sem, round(x_raw_std_over_sqrt_days, 6) AS x_raw_std_over_sqrt_days FROM stats"""


@query(_STATS_ALL)
def bin_stats_join(spark, d):
    return rounded(binstats.bin_stats_joined(_bins(spark, d), "ln_density_ratio_2.0"))


@query(_STATS_ALL)
def bin_stats_one_pass(spark, d):
    return rounded(binstats.bin_stats(_bins(spark, d), "ln_density_ratio_2.0"))


@query(_STATS + """ SELECT bucket, seasonal_bin AS bin, rows, unique_days AS days, round(x_mean, 6) AS raw_mean, round(x_daily_mean, 6) AS daily_mean,
 round(x_daily_mean_sem, 6) AS daily_sem, round(x_raw_std_over_sqrt_days, 6) AS raw_sem, round(x_raw_std, 6) AS raw_std FROM stats""")
def bin_stats_printed(spark, d):
    return rounded(binstats.printed(binstats.bin_stats(_bins(spark, d), "ln_density_ratio_2.0")))


@query(_STATS + """ SELECT bucket, round(max(x_daily_mean_sem), 6) AS max_daily_mean_sem, round(max(x_raw_std_over_sqrt_days), 6) AS max_raw_std_over_sqrt_days,
 round(max(x_raw_std), 6) AS max_raw_std FROM stats GROUP BY bucket""")
def bin_stats_maxima(spark, d):
    return rounded(binstats.maxima(binstats.bin_stats(_bins(spark, d), "ln_density_ratio_2.0")))


@query(f"""WITH {OBS} SELECT count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS unique_days, min(ts) AS start, max(ts) AS "end", round(min(altitude) / 1000, 6) AS min_alt_km,
 round(max(altitude) / 1000, 6) AS max_alt_km FROM obs""")
def mission_summary(spark, d):
    return rounded(binstats.mission_summary(observations(spark, d)))


@query("""SELECT CASE WHEN f < 100 THEN '<100' WHEN f < 160 THEN '100-160' WHEN f IS NOT NULL THEN '>=160' END AS bucket, count(*) AS rows
FROM (SELECT CASE WHEN l_quantity > 45 THEN NULL ELSE 70.0 + 2.5 * (l_quantity - 1) END AS f FROM lineitem) GROUP BY ALL""")
def f107_bucket_counts(spark, d):
    flux = F.when(F.col("l_quantity") <= 45, 70.0 + 2.5 * (F.col("l_quantity") - 1))
    return read(spark, d, "lineitem").groupBy(T.flux_bucket(flux).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows, round(sum(l_extendedprice), 2) AS metres FROM lineitem WHERE l_extendedprice / 1000 BETWEEN 30 AND 50")
def altitude_band(spark, d):
    rows = read(spark, d, "lineitem").where(filters.altitude_band(F.col("l_extendedprice"), 30.0, 50.0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("metres"))


_EXCLUSION = """SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate + INTERVAL 9 YEAR AS o_orderdate FROM orders)
WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND (o_orderdate < TIMESTAMP '{}-01-01' OR o_orderdate > TIMESTAMP '2009-12-31')"""


def _shifted(spark, d):
    later = F.expr("o_orderdate + INTERVAL '9' YEAR")
    return read(spark, d, "orders").select("o_orderkey", later.cast("timestamp_ntz").alias("o_orderdate"))


@query(_EXCLUSION.format(2006))
def exclusion_window_caption(spark, d):
    return _shifted(spark, d).where(filters.excluded_years(F.col("o_orderdate"), False))


@query(_EXCLUSION.format(2005))
def exclusion_window_section(spark, d):
    return _shifted(spark, d).where(filters.excluded_years(F.col("o_orderdate"), True))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'F'")
def quality_flags(spark, d):
    flags = [F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.when(F.col("l_linestatus") == "F", 1).otherwise(0)]
    return read(spark, d, "lineitem").where(filters.no_flags(flags)).select("l_orderkey", "l_linenumber")


@query(f"""WITH {OBS} SELECT 'CHAMP' AS name, count(*) AS rows FROM obs WHERE altitude / 1000 BETWEEN 300 AND 500 AND anomalous = 0 AND ts >= TIMESTAMP '2001-01-01'
 AND (ts < TIMESTAMP '2006-01-01' OR ts > TIMESTAMP '2009-12-31')
UNION ALL SELECT 'GOCE', count(*) FROM obs WHERE altitude / 1000 BETWEEN 225 AND 300 AND anomalous = 0 AND degraded = 0""")
def mission_dispatch(spark, d):
    rows = observations(spark, d)
    counts = [rows.where(filters.mission_filter(m)).agg(F.lit(m).alias("name"), F.count(F.lit(1)).alias("rows")) for m in ("CHAMP", "GOCE")]
    return merge.strict_union(counts)


@query("SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) + max(CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END) AS days FROM orders GROUP BY o_custkey")
def distinct_days(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(n_unique(T.date_bin(F.col("o_orderdate"))).alias("days"))


@query("SELECT n_nationkey, n_regionkey, chr((97 + n_regionkey * 3 + n_nationkey % 3)::INTEGER) AS letter FROM nation")
def panel_letters(spark, d):
    return read(spark, d, "nation").select("n_nationkey", "n_regionkey", X.panel_letter(F.col("n_regionkey"), F.col("n_nationkey") % 3).alias("letter"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice / (900 * l_quantity)), 6) AS ratio FROM lineitem")
def log_ratio_guarded(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(log_ratio(F.col("l_extendedprice"), 900 * F.col("l_quantity")), 6).alias("ratio"))


_DAYS = """days AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) / 1000 AS flux FROM orders GROUP BY ALL),
means AS (SELECT day, flux, avg(flux) OVER (ORDER BY day RANGE BETWEEN INTERVAL 40 DAY PRECEDING AND INTERVAL 40 DAY FOLLOWING) AS mean FROM days)"""


def _space_weather(spark, d):
    """Daily totals of orders in the place of solar flux."""
    days = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("F107_OBS"))
    days = weather.centred_mean(days, "F107_OBS").withColumnRenamed("F107_OBS_81day_avg", "F107_OBS_CENTER81")
    return days.withColumns({"F107_DATA_TYPE": F.lit("OBS"), "YEAR": F.year("date"), "MONTH": F.month("date"), "DAY": F.dayofmonth("date")})


@query(f"""WITH {_DAYS} SELECT day AS date, CASE WHEN flux > 400 THEN round(mean, 2) ELSE round(flux, 5) END AS F107_OBS, round(mean, 2) AS F107_OBS_CENTER81, CASE WHEN flux > 400 THEN 'INT' ELSE 'OBS' END AS F107_DATA_TYPE FROM means""")
def high_flux_replace(spark, d):
    fixed = weather.replace_high_flux(_space_weather(spark, d)).select("date", "F107_OBS", "F107_OBS_CENTER81", "F107_DATA_TYPE")
    # totals have five decimals, means of them any number
    shown = F.when(F.col("F107_DATA_TYPE") == "INT", F.round("F107_OBS", 2)).otherwise(F.round("F107_OBS", 5))
    return fixed.withColumns({"F107_OBS": shown, "F107_OBS_CENTER81": F.round("F107_OBS_CENTER81", 2)})


@query(f"WITH {_DAYS} SELECT count(*) FILTER (WHERE flux > 400) AS high, bool_or(flux > 400) AS any_high FROM means")
def high_flux_count(spark, d):
    high = F.col("F107_OBS") > weather.HIGH_FLUX
    return _space_weather(spark, d).agg(F.count_if(high).alias("high"), F.bool_or(high).alias("any_high"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN
 (SELECT CAST(min(l_shipdate) AS DATE) - 3 FROM lineitem WHERE l_orderkey < 40) AND (SELECT CAST(max(l_shipdate) AS DATE) + 1 FROM lineitem WHERE l_orderkey < 40)""")
def padded_slice(spark, d):
    times = read(spark, d, "lineitem").where("l_orderkey < 40").select(F.col("l_shipdate").alias("timestamp"))
    return weather.slice_around(read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), times)


@query("""WITH file AS (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linestatus = 'F' AND year(l_shipdate) = 1998)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT min(day) - 3 FROM file) AND (SELECT max(day) + 1 FROM file)""")
def padded_slice_year(spark, d):
    """As ``padded_slice``, around all that one mission measured in a year."""
    times = observations(spark, d).where("mission = 'F' and timestamp >= timestamp_ntz'1998-01-01' and timestamp < timestamp_ntz'1999-01-01'")
    return weather.slice_around(read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), times)


@query("""SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour_of, round(sin(epoch(date_trunc('hour', ts)::TIMESTAMP) / 86400.0), 6) AS flux FROM events""")
def hour_dedupe_lookup(spark, d):
    def lookup(hours: DataFrame) -> DataFrame:
        seconds = F.unix_timestamp(F.col("hour").cast("timestamp"))
        return hours.select("hour", F.col("hour").alias("hour_of"), F.sin(seconds / 86400.0).alias("flux"))

    return rounded(weather.lookup_by_hour(read(spark, d, "events").select("event_id", "ts"), lookup, "ts").select("event_id", "hour_of", "flux"))


@query(f"""WITH {_DAYS} SELECT l_orderkey, l_linenumber, round(a.flux, 5) AS f107, round(b.mean, 2) AS f107a FROM lineitem
LEFT JOIN means a ON a.day = CAST(l_shipdate AS DATE) - 1 LEFT JOIN means b ON b.day = CAST(l_shipdate AS DATE)""")
def weather_lookup_daily(spark, d):
    daily = _space_weather(spark, d)
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = weather.attach_daily(rows, daily.select("date", F.col("F107_OBS").alias("f107")), "l_shipdate", lag_days=1)
    rows = weather.attach_daily(rows, daily.select("date", F.col("F107_OBS_CENTER81").alias("f107a")), "l_shipdate")
    return rows.drop("l_shipdate").withColumns({"f107": F.round("f107", 5), "f107a": F.round("f107a", 2)})


_AP = ", ".join(f"{i + 1} * 1.5 + day(day) AS AP{i + 1}" for i in range(8))


@query(f"""WITH {_DAYS}, wide AS (SELECT day, flux AS AP_AVG, {_AP} FROM means),
slots AS (SELECT datediff('day', DATE '1970-01-01', day) * 8 + i AS slot, CASE i {" ".join(f"WHEN {i} THEN AP{i + 1}" for i in range(8))} END::DOUBLE AS ap, AP_AVG FROM wide, range(8) r(i))
SELECT slot::BIGINT AS slot, round(AP_AVG, 6) AS a0, round(ap, 6) AS a1, round(avg(ap) OVER (ORDER BY slot RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 6) AS a2,
 round(avg(ap) OVER (ORDER BY slot RANGE BETWEEN 11 PRECEDING AND 4 PRECEDING), 6) AS a5, round(avg(ap) OVER (ORDER BY slot RANGE BETWEEN 19 PRECEDING AND 12 PRECEDING), 6) AS a6 FROM slots""")
def index_history(spark, d):
    daily = _space_weather(spark, d).withColumn("AP_AVG", F.col("F107_OBS"))
    daily = daily.withColumns({f"AP{i + 1}": (i + 1) * F.lit(1.5) + F.dayofmonth("date") for i in range(8)}).drop("date")
    history = weather.ap_history(daily)
    return rounded(history.select("slot", *[F.get("aps", F.lit(i)).alias(f"a{i}") for i in (0, 1, 2, 5, 6)]))


@query("SELECT event_id, ts AS timestamp FROM events")
def timestamp_compose(spark, d):
    rows = read(spark, d, "events").select("event_id", F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm:ss.SSSSSS").alias("time"))
    return rows.select("event_id", T.compose(F.col("date"), F.col("time")).alias("timestamp"))


@query("SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS timestamp FROM events")
def timestamp_compact_parse(spark, d):
    return read(spark, d, "events").select("event_id", T.parse_compact(F.date_format("ts", "yyyyMMddHHmm")).alias("timestamp"))


@query("SELECT event_id, year(ts) AS year, dayofyear(ts) AS doy, round(hour(ts) * 3600 + minute(ts) * 60 + (microsecond(ts) / 1000000.0), 6) AS seconds FROM events")
def second_of_day(spark, d):
    return read(spark, d, "events").select("event_id", F.year("ts").cast("long").alias("year"), F.dayofyear("ts").cast("long").alias("doy"), F.round(T.second_of_day(F.col("ts")), 6).alias("seconds"))


_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), split AS
 (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS tokens FROM lines)"""


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, sum(len(tokens))::BIGINT AS tokens FROM split WHERE NOT starts_with(line, '#') AND len(tokens) > 0 GROUP BY doc_id")
def whitespace_split(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return normalised(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("tokens")).cast("long").alias("tokens"))


@query(f"WITH {_LINES} SELECT doc_id, array_to_string(tokens, ';') AS joined FROM split WHERE NOT (starts_with(line, 'A') OR starts_with(line, 'E')) AND len(tokens) > 0")
def comment_filter(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return normalised(lines, ("A", "E")).select("doc_id", F.array_join("tokens", ";").alias("joined"))


@query("SELECT p_partkey, upper(string_split(replace(p_name, ' ', '_'), '_')[1]) AS code FROM part")
def mission_code(spark, d):
    return read(spark, d, "part").select("p_partkey", X.mission_code(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("code"))


@query("SELECT o_orderkey, 'HASDM_' || strftime(o_orderdate, '%Y') AS code FROM orders")
def regex_year(spark, d):
    name = F.concat(F.lit("den_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".txt"))
    return read(spark, d, "orders").select("o_orderkey", X.archive_code(name).alias("code"))


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '_raw' END AS stem FROM customer")
def suffix_strip(spark, d):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "_merged").otherwise("_raw"))
    return read(spark, d, "customer").select("c_custkey", X.strip_suffix(name, "_merged").alias("stem"))


@query("SELECT c_custkey, 'msis/' || c_name || '_msis' AS name FROM customer")
def name_replace(spark, d):
    return read(spark, d, "customer").select("c_custkey", X.renamed(F.concat(F.lit("merged/"), F.col("c_name"), F.lit("_merged")), "merged", "msis").alias("name"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), ''), 'download.bin') AS tail FROM pages")
def url_tail(spark, d):
    return read(spark, d, "pages").select("page_id", X.url_tail(F.col("url")).alias("tail"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'elsewhere/' || s_name ELSE s_name END AS path FROM supplier")
def relative_path(spark, d):
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "elsewhere/").otherwise("data/original/"), F.col("s_name"))
    return read(spark, d, "supplier").select("s_suppkey", X.relative(path, "data/original").alias("path"))


@query("""SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS name FROM pages) WHERE NOT ends_with(name, '/')""")
def href_index(spark, d):
    return catalog.href_names(read(spark, d, "pages"))


def _file_names(spark, d):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    dated = F.concat(F.lit("_"), F.when(key % 4 == 0, F.date_format(day, "yyyy-MM")).when(key % 4 == 1, "undated").otherwise(F.concat(F.date_format(day, "yyyy_MM"), F.lit("_v02"))))
    kind = F.when(key % 3 == 0, "GA_DNS_ACC").when(key % 3 == 1, "xx_dns").otherwise("GB_OTHER")
    return read(spark, d, "orders").select("o_orderkey", F.concat(kind, dated, F.lit(".zip")).alias("name"))


_NAMES = """names AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 <> 1 AS dated, year(o_orderdate) * 100 + month(o_orderdate) AS ym,
 CASE o_orderkey % 3 WHEN 0 THEN 'GA_DNS_ACC' WHEN 1 THEN 'xx_dns' ELSE 'GB_OTHER' END || '_' ||
 CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN 'undated' ELSE strftime(o_orderdate, '%Y_%m') || '_v02' END || '.zip' AS name FROM orders)"""


@query(f"WITH {_NAMES} SELECT o_orderkey, name, CASE WHEN dated THEN ym END::INTEGER AS ym FROM names WHERE NOT dated OR ym BETWEEN 199603 AND 199807")
def ym_range_filter(spark, d):
    rows = _file_names(spark, d).where(X.in_months(F.col("name"), 199603, 199807))
    return rows.withColumn("ym", X.year_month(F.col("name")))


@query(f"WITH {_NAMES} SELECT name FROM names WHERE starts_with(name, 'GA_DNS_ACC_') AND (NOT dated OR ym >= 199701)")
def file_select(spark, d):
    return catalog.select_files(_file_names(spark, d).select("name"), ["GA_DNS_ACC_", "GB_DNS_ACC_"], 199701, None, True)


@query(f"WITH {_NAMES} SELECT name FROM names WHERE contains(upper(name), 'DNS') AND (NOT dated OR ym <= 199701)")
def file_select_fallback(spark, d):
    return catalog.select_files(_file_names(spark, d).select("name"), ["CH_DNS_ACC_"], None, 199701, True)


@query("SELECT s_suppkey, 'a/' || CASE s_suppkey % 4 WHEN 0 THEN 'tmp' WHEN 1 THEN 'tmpfoo' WHEN 2 THEN 'b/tmp' ELSE 'c' END || '/' || s_name AS path FROM supplier WHERE s_suppkey % 4 IN (1, 3)")
def path_exclusion(spark, d):
    folder = F.element_at(F.array(*map(F.lit, ("tmp", "tmpfoo", "b/tmp", "c"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return catalog.without_dirs(read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("a/"), folder, F.lit("/"), F.col("s_name")).alias("path")), ["tmp"])


_RUNS = "runs AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status FROM lineitem), done AS (SELECT DISTINCT k FROM runs WHERE status = 'success'), outs AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'O')"


def _files(spark, d):
    key = F.col("o_orderkey").cast("string")
    return read(spark, d, "orders").select(key.alias("source_file"), F.concat(F.lit("out/"), key).alias("output_file"), "o_orderstatus")


def _pending(spark, d):
    files = _files(spark, d)
    runs = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_file"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"))
    outputs = files.where("o_orderstatus <> 'O'").select("output_file")
    return manifest.pending(files.drop("o_orderstatus"), runs, outputs)


@query(f"WITH {_RUNS} SELECT o_orderkey::VARCHAR AS source_file, 'out/' || o_orderkey AS output_file FROM orders WHERE o_orderkey NOT IN (SELECT k FROM outs)")
def pending_anti(spark, d):
    return _pending(spark, d)[0]


@query(f"WITH {_RUNS} SELECT o_orderkey::VARCHAR AS source_file, 'out/' || o_orderkey AS output_file, CASE WHEN o_orderkey IN (SELECT k FROM done) THEN 'manifest' ELSE 'output_exists' END AS reason FROM orders WHERE o_orderkey IN (SELECT k FROM outs)")
def skipped_reasons(spark, d):
    return _pending(spark, d)[1]


@query(f"WITH {_RUNS} SELECT k::VARCHAR AS source_file FROM done")
def completed_semi(spark, d):
    runs = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_file"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"))
    return manifest.completed(runs)


@query("""SELECT path, seq, round(total, 2) AS total FROM (SELECT o_custkey AS path, o_orderkey AS seq, o_totalprice AS total,
 row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderdate >= TIMESTAMP '1998-01-01') DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def manifest_upsert(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), F.round("o_totalprice", 2).alias("total"), "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return manifest.upsert(rows.where(~new).drop("o_orderdate"), rows.where(new).drop("o_orderdate"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def manifest_append_union(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return merge.strict_union([rows.where(F.col("status") == "O"), rows.where(F.col("status") != "O")])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, d):
    return manifest.status_counts(read(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT strftime(m, '%Y%m') AS ym, year(m)::INTEGER AS year, month(m)::INTEGER AS month FROM (SELECT unnest(generate_series(DATE '1999-11-01', DATE '2001-02-01', INTERVAL 1 MONTH)) AS m)")
def month_spine(spark, d):
    return T.month_spine(spark, "1999-11", "2001-02")


@query("SELECT sum(ceil(n / 3.0))::BIGINT AS batches FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def batch_estimate(spark, d):
    return manifest.batch_estimate(read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows")), batch=3)


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def time_system_collapse(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("UTC").alias("Time System"))
    return merge.collapse_constant(rows, "Time System")


@query("SELECT l_orderkey, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 3723 SECOND AS timestamp FROM lineitem")
def single_file_sorted_merge(spark, d):
    rows = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("Date yyyy-mm-dd"), F.lit("01:02:03.000").alias("Time hh:mm:ss.sss"), F.lit("UTC").alias("Time System"), "l_orderkey", "l_returnflag")
    return merge.merge([rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")])


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(11, CAST(l_quantity AS BIGINT) - 20))::BIGINT AS clipped, l_extendedprice * 1000.0 AS metres, round(sqrt(l_extendedprice), 6) AS root FROM lineitem")
def scalar_expressions(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", clip(F.col("l_quantity").cast("long") - 20, 0, 11).cast("long").alias("clipped"), (F.col("l_extendedprice") * 1000.0).alias("metres"), F.round(F.sqrt("l_extendedprice"), 6).alias("root")
    )


def closed_form(times, lon, lat, alt_km, f107, f107a, aps, version):
    """Stands for a density model where none is installed."""
    return alt_km * 0.5 + lon - lat + f107 * float(version) + f107a + aps[:, 0]


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000 * 0.5 + l_discount - l_tax + 0 * l_quantity + 80 + 4, 6) AS v0, round(l_extendedprice / 1000 * 0.5 + l_discount - l_tax + 2.1 * l_quantity + 80 + 4, 6) AS v21,
 round(l_extendedprice / 1000 * 0.5 + l_discount - l_tax + 2 * 150 + 150, 6) AS ct20, 4.0::DOUBLE AS ap FROM lineitem""")
def model_udf_stub(spark, d):
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("timestamp"), F.col("l_discount").alias(LONGITUDE), F.col("l_tax").alias(LATITUDE), F.col("l_extendedprice").alias(ALTITUDE),
        F.col("l_quantity").alias("f107"), F.lit(80.0).alias("f107a"), F.array_repeat(F.lit(4.0), 7).alias("aps"),
    )
    made = model.add_densities(rows, closed_form)
    return rounded(made.select("l_orderkey", "l_linenumber", c("msis_density_0").alias("v0"), c("msis_density_2.1").alias("v21"), c("msis_density_ct_2.0").alias("ct20"), "ap"))


@query("""SELECT o_orderkey, round(ln(o_totalprice / 1000), 6) AS r0, round(CASE WHEN o_orderkey % 3 <> 0 THEN ln(o_totalprice * 2 / 1000) END, 6) AS second FROM orders""")
def analysed_ratios(spark, d):
    rows = read(spark, d, "orders").select(F.lit("X").alias("mission"), F.timestamp_seconds("o_orderkey").cast("timestamp_ntz").alias("timestamp"), "o_orderkey", F.col("o_totalprice").alias("msis_density_0"), F.lit(1000.0).alias("Density (kg/m^3)"))
    second = rows.where("o_orderkey % 3 <> 0").select("mission", "timestamp", (c("msis_density_0") * 2).alias("matlab_density"), F.lit(0.0).alias("Altitude_m_"))
    out = ratios.analysed(rows, second)
    return rounded(out.select("o_orderkey", c("ln_density_ratio_0").alias("r0"), c("ln_density_ratio_matlab_density").alias("second")))


# Below, tables are first written as files, which are then read by the operator.


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that are made of the tables; it stays until the shared folder is cleared."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _archive_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archive text; those of status P lack their last value."""
    rows = read(spark, d, "orders")
    line = F.concat_ws("\t ", F.date_format("o_orderdate", "yyyyMMddHHmm"), "o_orderkey", F.round(F.col("o_totalprice") / 1000, 3).cast("string"), F.lit("1.5"), F.lit("-20"), F.lit("7"), F.when(F.col("o_orderstatus") != "P", F.lit("2e-12")))
    return rows.select(line.alias("line"), F.col("o_orderstatus").alias("status"))


def _decoded(spark: SparkSession, d: str) -> decode.Decoded:
    """Open orders in zip files, others in plain ones by status."""
    folder, lines = _folder(spark, "text"), _archive_lines(spark, d)
    archive.write_archives(lines.where("status = 'O'").select("line"), f"{folder}/zips")
    lines.where("status <> 'O'").write.partitionBy("status").text(f"{folder}/plain")
    return decode.decode_archive(spark, [f"{folder}/zips", f"{folder}/plain"], f"{folder}/out")


@query("""SELECT o_orderkey, round(round(o_totalprice / 1000, 3) * 1000, 3) AS metres, CAST(o_orderdate AS TIMESTAMP) AS timestamp, 1.5::DOUBLE AS lat, -20.0::DOUBLE AS lon, 2e-12::DOUBLE AS rho FROM orders WHERE o_orderstatus <> 'P'""")
def text_ingest(spark, d):
    rows = spark.read.parquet(_decoded(spark, d).path)
    return rows.select(F.col("JulianDay").cast("long").alias("o_orderkey"), F.round(c(ALTITUDE), 3).alias("metres"), "timestamp", c(LONGITUDE).alias("lon"), c(LATITUDE).alias("lat"), c(DENSITY).alias("rho")).select("o_orderkey", "metres", "timestamp", "lat", "lon", "rho")


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'decoded' END AS status, sum((o_orderstatus <> 'P')::BIGINT)::BIGINT AS rows, sum((o_orderstatus = 'P')::BIGINT)::BIGINT AS bad_rows FROM orders GROUP BY 1")
def file_verdicts(spark, d):
    return _decoded(spark, d).files.where("rows + bad_rows > 0").groupBy("status").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 3723 SECOND AS timestamp FROM lineitem")
def merge_by_footers(spark, d):
    """A decoded table for each year, of which those of two quarters of one year overlap."""
    folder = _folder(spark, "merge")
    rows = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("Date yyyy-mm-dd"), F.lit("01:02:03.000").alias("Time hh:mm:ss.sss"), F.lit("UTC").alias("Time System"), "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"))
    rows = rows.withColumn("year", F.when(F.col("year") == 1995, F.concat(F.lit("1995"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"))).otherwise(F.col("year").cast("string")))
    rows.hint("rebalance", "year").write.partitionBy("year").parquet(folder)
    years = [r["year"] for r in rows.select("year").distinct().collect()]
    merge_sorted.merge_sorted(spark, [f"{folder}/year={y}" for y in sorted(years)], f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("l_orderkey", "l_linenumber", "timestamp")


@query("SELECT o_orderkey, o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS part FROM orders")
def manifest_commits(spark, d):
    """Three appends to a log, put together to one file after the second."""
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    log = CommittedTable(spark, _folder(spark, "log"), None, "parquet")
    for i, part in enumerate((rows.where("status = 'F'"), rows.where("status = 'O'"), rows.where("status not in ('F', 'O')"))):
        log.append(part.withColumn("part", F.lit(i)))
        if i == 1:
            log.compact(one_file=False)
    return log.read()


@query("""SELECT o_orderkey, 0 AS version FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'F'""")
def table_versions(spark, d):
    """All versions of a table that is replaced by a part of itself and then appended to."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    table = CommittedTable(spark, _folder(spark, "versions"))
    table.replace(rows)
    table.replace(table.read().where("o_orderstatus = 'O'"))
    table.append(rows.where("o_orderstatus = 'F'"))
    return merge.strict_union([table.read(v).select("o_orderkey", F.lit(v).alias("version")) for v in range(3)])


@query(ORACLES["analysed_ratios"])
def analysed_bucketed(spark, d):
    """As ``analysed_ratios``, of tables saved by bucket."""
    rows = read(spark, d, "orders").select(F.lit("X").alias("mission"), F.timestamp_seconds("o_orderkey").cast("timestamp_ntz").alias("timestamp"), "o_orderkey", F.col("o_totalprice").alias("msis_density_0"), F.lit(1000.0).alias("Density (kg/m^3)"))
    second = rows.where("o_orderkey % 3 <> 0").select("mission", "timestamp", (c("msis_density_0") * 2).alias("matlab_density"), F.lit(0.0).alias("Altitude_m_"))
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("model", "second")]
    for frame, name in zip((rows, second), names, strict=True):
        ratios.write_bucketed(frame, name, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = ratios.analysed_tables(spark, *names)
    return rounded(out.select("o_orderkey", c("ln_density_ratio_0").alias("r0"), c("ln_density_ratio_matlab_density").alias("second")))


@query(ORACLES["padded_slice_year"])
def slice_by_month(spark, d):
    """As ``padded_slice_year``, of orders whose files lie by month; the range stays in the plan."""
    folder = _folder(spark, "months")
    layout.write_by_month(read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), folder, "date", keys=())
    times = observations(spark, d).where("mission = 'F' and timestamp >= timestamp_ntz'1998-01-01' and timestamp < timestamp_ntz'1999-01-01'")
    return weather.slice_by_month(layout.read_by_month(spark, folder), times).select("o_orderkey", "date")


@query(f"""WITH {_DAYS} SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000 * 0.5 + l_discount - l_tax + 2.1 * round(a.flux, 5) + round(b.mean, 2) + 4, 6) AS v21, 4.0::DOUBLE AS ap
FROM lineitem JOIN means a ON a.day = CAST(l_shipdate AS DATE) - 1 JOIN means b ON b.day = CAST(l_shipdate AS DATE)""")
def generated_files(spark, d):
    """Line items as a merged table for each year and flag, all of which one plan generates; days without weather are left out."""
    folder = _folder(spark, "files")
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.col("l_discount").alias(LONGITUDE), F.col("l_tax").alias(LATITUDE), F.col("l_extendedprice").alias(ALTITUDE),
        F.concat_ws("_", F.year("l_shipdate"), "l_returnflag", F.lit("merged")).alias("name"),
    )
    rows.hint("rebalance", "name").write.partitionBy("name").parquet(folder)
    daily = _space_weather(spark, d).withColumns({"F107_OBS": F.round("F107_OBS", 5), "F107_OBS_CENTER81": F.round("F107_OBS_CENTER81", 2), "AP_AVG": F.lit(4.0), **{f"AP{i}": F.lit(4.0) for i in range(1, 9)}}).drop("date")
    files = [f"{folder}/name={r['name']}" for r in rows.select("name").distinct().collect()]
    log = generate.generate(spark, files, closed_form, daily, f"{folder}/log")
    made = [r["output_file"] for r in log.where("status = 'success'").collect()]
    out = spark.read.parquet(*made).where("f107 is not null and f107a is not null")
    return out.select("l_orderkey", "l_linenumber", F.round(c("msis_density_2.1"), 6).alias("v21"), "ap")


@query(f"""WITH {_DAYS} SELECT l_orderkey, l_linenumber, round(a.flux, 5) AS flux, round(b.mean, 2) AS mean, round(l_extendedprice / 1000 * 0.5 + l_discount - l_tax + 2 * round(a.flux, 5) + 4, 6) AS without_mean
FROM lineitem JOIN means a ON a.day = CAST(l_shipdate AS DATE) - 1 JOIN means b ON b.day = CAST(l_shipdate AS DATE)""")
def second_branch(spark, d):
    """Line items through the second branch: written under its names, and read back under ours."""
    folder = _folder(spark, "second")
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.col("l_discount").alias(LONGITUDE), F.col("l_tax").alias(LATITUDE), F.col("l_extendedprice").alias(ALTITUDE)
    )
    rows.write.parquet(f"{folder}/merged")
    daily = _space_weather(spark, d).withColumns({"AP_AVG": F.lit(4.0), **{f"AP{i}": F.lit(4.0) for i in range(1, 9)}}).drop("date")
    second.write_second(spark, f"{folder}/merged", f"{folder}/out", daily, closed_form)
    out = ratios.restored(spark.read.parquet(f"{folder}/out")).where(f"`{ALTITUDE}` is not null and matlab_f107_daily is not null and matlab_f107_81day_avg is not null")
    return out.select("l_orderkey", "l_linenumber", F.round("matlab_f107_daily", 5).alias("flux"), F.round("matlab_f107_81day_avg", 2).alias("mean"), F.round(F.col("matlab_density") - F.col("matlab_f107_81day_avg"), 6).alias("without_mean"))


_FIELDS = "lower(l_returnflag) || '/' || l_orderkey || '/' || l_linenumber"


@query(f"""SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'unknown' ELSE 'supplier ' || l_suppkey END AS dataset, {_FIELDS} AS path, CASE WHEN l_linenumber = 1 THEN '' ELSE 'https://example.org/' || l_orderkey END AS url,
 CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'downloaded' END AS status, '' AS timestamp, CASE WHEN l_returnflag <> 'N' THEN l_quantity::BIGINT END AS size_bytes FROM lineitem""")
def manifest_json(spark, d):
    """A JSON manifest for each supplier, a line each, of which many entries lack fields."""
    folder, known = _folder(spark, "manifests"), F.col("l_returnflag") != "N"
    entry = F.struct(
        F.concat_ws("/", F.lower("l_returnflag"), "l_orderkey", "l_linenumber").alias("path"),
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("https://example.org/"), "l_orderkey")).alias("url"),
        F.when(known, "downloaded").alias("status"),
        F.when(known, F.col("l_quantity").cast("long")).alias("size_bytes"),
    )
    named = F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("supplier "), "l_suppkey")).alias("dataset")
    read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(entry).alias("entries")).select(named, "entries").write.json(folder)
    rows = manifest.entries(tables.read_download_manifest(spark, folder, lines=True))
    return rows.select("dataset", "path", "url", "status", "timestamp", "size_bytes")


@query(f"""WITH {_DAYS} SELECT year(day)::INTEGER AS YEAR, month(day)::INTEGER AS MONTH, day(day)::INTEGER AS DAY, (day(day) % 7)::DOUBLE AS AP3, round(flux, 5) AS F107_OBS, round(mean, 2) AS F107_OBS_CENTER81,
 CASE WHEN flux > 400 THEN 'PRD' ELSE 'OBS' END AS F107_DATA_TYPE, NULL::DOUBLE AS AP_AVG FROM means""")
def space_weather_csv(spark, d):
    """Daily totals in published CSV form: dates, names with dots, another order, columns too many and one too few."""
    folder, days = _folder(spark, "weather"), _space_weather(spark, d)
    day = F.dayofmonth("date")
    published = [F.col("date").cast("string").alias("DATE"), F.lit(2500).alias("BSRN"), *[(day % (i + 4)).alias(f"AP{i}") for i in range(8, 0, -1)], F.lit(None).cast("string").alias("ISN")]
    flux = [F.round("F107_OBS_CENTER81", 2).alias("F10.7_OBS_CENTER81"), F.when(F.col("F107_OBS") > weather.HIGH_FLUX, "PRD").otherwise("OBS").alias("F10.7_DATA_TYPE"), F.round("F107_OBS", 5).alias("F10.7_OBS")]
    days.select(*published, *flux).write.option("header", True).csv(folder)
    rows = weather.pruned(tables.read_space_weather(spark, folder))
    return rows.select("YEAR", "MONTH", "DAY", "AP3", "F107_OBS", "F107_OBS_CENTER81", "F107_DATA_TYPE", "AP_AVG")


def _mission_text(spark: SparkSession, d: str, folder: str) -> list[str]:
    """Line items as mission text, a comment before each: zipped if returned, else plain and by year; those of 1995 lack their
    last value."""
    rows = read(spark, d, "lineitem")
    values = [F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("01:02:03.250"), F.lit("UTC"), "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_quantity", F.lit("0"), F.lit("0")]
    line = F.concat_ws(" \t", *[c(x).cast("string") if isinstance(x, str) else x for x in values], F.when(F.year("l_shipdate") != 1995, F.lit("1e-3")))
    lines = rows.select("l_returnflag", F.year("l_shipdate").alias("year"), F.explode(F.array(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "  ").otherwise(""), F.lit("# a b")), line)).alias("line"))
    zips = lines.where("l_returnflag = 'R' and year <> 1995")
    archive.write_archives(zips.select("line"), f"{folder}/zips", ".TXT")
    lines.where("not (l_returnflag = 'R' and year <> 1995)").drop("l_returnflag").hint("rebalance", "year").write.partitionBy("year").text(f"{folder}/plain")
    return [f"{folder}/zips", f"{folder}/plain"]


@query("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, '01:02:03.250' AS time, l_extendedprice AS altitude, l_discount AS lon, l_tax AS lat, l_quantity AS density FROM lineitem WHERE year(l_shipdate) <> 1995""")
def mission_ingest(spark, d):
    folder = _folder(spark, "mission")
    decoded = decode.decode_mission(spark, "champ", _mission_text(spark, d, folder), f"{folder}/out", f"{folder}/manifest")
    logged = tables.read_csv(spark, f"{folder}/manifest", DECODE_MANIFEST)
    if logged.count() != decoded.files.where("status = 'decoded'").count():
        raise ValueError("the manifest doesn't have each decoded file once")
    rows = spark.read.parquet(decoded.path)
    return rows.select(
        c("Argument of Latitude (deg)").cast("long").alias("l_orderkey"), c(LOCAL_TIME).cast("int").alias("l_linenumber"), c(DATE).alias("day"), c(TIME).alias("time"),
        c(ALTITUDE).alias("altitude"), c(LONGITUDE).alias("lon"), c(LATITUDE).alias("lat"), c(DENSITY).alias("density"),
    )


@query("""WITH said AS (SELECT page_id, coalesce(length(html), 0) AS n, CASE WHEN page_id % 7 = 0 THEN 'https://Login.example.org/' || page_id ELSE coalesce(url, 'http://x') END AS url,
 CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS code, CASE WHEN page_id % 5 = 0 THEN 'text/HTML;charset=utf-8' ELSE 'application/zip' END AS kind FROM pages),
judged AS (SELECT *, page_id % 7 <> 0 AND page_id % 5 <> 0 AND code = 200 AS told, page_id % 3 <> 0 AS any_bytes FROM said)
SELECT 'p/' || page_id AS path, url, CASE WHEN told AND any_bytes AND n > 0 THEN 'downloaded' ELSE 'failed' END AS status, CASE WHEN told AND any_bytes AND n > 0 THEN n END AS size_bytes,
 CASE WHEN NOT told THEN left('not a file:  ' || code || '  ' || kind || ' ' || url, 212) WHEN NOT any_bytes OR n = 0 THEN 'empty answer' END AS error FROM judged""")
def fetch_answers(spark, d):
    """What fetches of pages would report: some are answered by a login page, by HTML, by an error or with nothing."""
    page = F.col("page_id")
    url = F.when(page % 7 == 0, F.concat(F.lit("https://Login.example.org/"), page)).otherwise(F.coalesce("url", F.lit("http://x")))
    line = F.concat(F.lit(" "), F.when(page % 11 == 0, "404").otherwise("200"), F.lit("  "), F.when(page % 5 == 0, "text/HTML;charset=utf-8").otherwise("application/zip"), F.lit(" "), url)
    size = F.when(page % 3 != 0, F.length("html")).otherwise(0)
    reports = read(spark, d, "pages").select(F.concat(F.lit("p/"), page).alias("path"), size.alias("size"), line.alias("line"))
    return manifest.answered(reports).select("path", "url", "status", "size_bytes", "error")


@query("""SELECT p_partkey, 'm/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.csv' ELSE '.zip' END AS path, p_partkey % 3 <> 1 OR p_partkey % 5 = 0 AS needed FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 6 <> 5""")
def download_plan(spark, d):
    """Files wanted by parts, some of which a listing has, once empty and then whole, or empty only."""
    part, path = F.col("p_partkey"), F.concat(F.lit("m/"), "p_partkey", F.when(F.col("p_partkey") % 4 == 0, ".csv").otherwise(".zip")).alias("path")
    rows = read(spark, d, "part")
    wanted = catalog.without_dirs(rows.where("p_partkey % 6 <> 5").select("p_partkey", path), ["tmp"])
    listed = rows.where("p_partkey % 3 = 1").select(path, F.explode(F.array(F.lit(0), F.when(part % 5 == 0, 0).otherwise(10))).alias("size"))
    return manifest.fetch_plan(wanted, listed)


_SHIFTED = OBS.replace("SELECT l_shipdate AS ts", "SELECT l_shipdate + INTERVAL 10 YEAR AS ts")
_CHOSEN = """chosen AS (SELECT name, 'CHAMP' AS who, b.* FROM binned b, (VALUES ('daily_mean_sem_from_2006', 2006), ('daily_mean_sem_from_2005', 2005), ('raw_observation_sem_from_2006', 2006)) v(name, y)
 WHERE altitude / 1000 BETWEEN 300 AND 500 AND anomalous = 0 AND ts >= TIMESTAMP '2001-01-01' AND (ts < make_timestamp(y, 1, 1, 0, 0, 0) OR ts > TIMESTAMP '2009-12-31') AND bucket IS NOT NULL
 UNION ALL SELECT name, 'GOCE', b.* FROM binned b, (VALUES ('daily_mean_sem_from_2006'), ('daily_mean_sem_from_2005'), ('raw_observation_sem_from_2006')) v(name)
 WHERE altitude / 1000 BETWEEN 225 AND 300 AND anomalous = 0 AND degraded = 0 AND bucket IS NOT NULL),
values_ AS (SELECT name, who, bucket, seasonal_bin, date_bin, avg(r0) AS r0, avg(r2) AS r2 FROM chosen WHERE NOT starts_with(name, 'raw') GROUP BY ALL
 UNION ALL SELECT name, who, bucket, seasonal_bin, date_bin, r0, r2 FROM chosen WHERE starts_with(name, 'raw'))"""
_SPREAD = "round(coalesce(stddev_samp({x}), 0) / sqrt(CASE WHEN starts_with(name, 'raw') THEN count(DISTINCT date_bin) ELSE count({x}) END), 6)"


@query(f"""WITH {_SHIFTED}, {_CHOSEN} SELECT name, who AS mission, bucket, seasonal_bin, (seasonal_bin + 0.5::DOUBLE) * 30.5::DOUBLE AS day_of_year, round(avg(r0), 6) AS msis_00_mean, {_SPREAD.format(x="r0")} AS msis_00_std,
 round(avg(r2), 6) AS msis_20_mean, {_SPREAD.format(x="r2")} AS msis_20_std, count(r0) AS count FROM values_ GROUP BY name, who, bucket, seasonal_bin""")
def figure_comparisons(spark, d):
    """The points of the three comparisons, of analysed tables ten years later."""
    folder = _folder(spark, "analysed")
    rows = observations(spark, d).drop("mission").withColumn("timestamp", F.col("timestamp") + F.make_ym_interval(F.lit(10)))
    tables.write(rows, folder)
    points = [p.withColumn("name", F.lit(name)) for name, (p, _) in figure.comparisons(spark, {"CHAMP": folder, "GOCE": folder}).items()]
    return rounded(merge.strict_union(points))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return fig_uncertainty_of_mean(spark, d)


