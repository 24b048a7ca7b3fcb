import datetime as dt
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from orbiteer.functions import text as X
from orbiteer.functions import time as T
from orbiteer.functions.numeric import c, clip, n_unique, safe_div, safe_log
from orbiteer.operators import binstats, filters, manifest, merge, model, ratios, weather
from orbiteer.plans import decode, download, figure, generate, stats
from orbiteer.queries import closed_form
from orbiteer.schemas import DOWNLOAD_ENTRY, RUN_MANIFEST, SCHEMAS, SPACE_WEATHER
from orbiteer.sources import catalog, tables
from orbiteer.sources.text import normalised, read_archive, read_mission, typed


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def stamp(text):
    return dt.datetime.fromisoformat(text)


def test_numeric_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.e,), (None,)], "x double")
    logs = [r[0] for r in df.select(safe_log(F.col("x"))).collect()]
    assert logs[0] == -math.inf and math.isnan(logs[1]) and logs[2] == 1.0 and logs[3] is None
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0)], "a double, b double")
    out = [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()]
    assert out[:2] == [math.inf, -math.inf] and math.isnan(out[2]) and out[3] == 2.0 and out[4] is None
    df = spark.createDataFrame([(-5,), (5,), (50,), (None,)], "x int")
    assert values(df.select(clip(F.col("x"), 0, 11).alias("y")), "y") == [(0,), (5,), (11,), (None,)]
    assert values(df.agg(n_unique(F.col("x")).alias("n")), "n") == [(4,)]
    assert values(spark.createDataFrame([(1,)], ["a.b"]), c("a.b")) == [(1,)]


@pytest.mark.parametrize("day,bin_", [("2004-01-01", 0), ("2004-12-31", 11), ("2003-01-31", 0), ("2003-02-01", 1), ("2003-12-31", 11)])
def test_seasonal_bin(spark, day, bin_):
    df = spark.createDataFrame([(stamp(day),)], "t timestamp_ntz")
    assert values(df.select(T.seasonal_bin(F.col("t")).alias("b")), "b") == [(bin_,)]


def test_flux_bucket(spark):
    df = spark.createDataFrame([(99.9,), (100.0,), (160.0,), (None,), (math.nan,)], "f double")
    assert [x for (x,) in values(df.select(T.flux_bucket(F.col("f")).alias("b")), "b")] == ["<100", "100-160", ">=160", None, ">=160"]


def test_times(spark):
    df = spark.createDataFrame([("2004-02-29", "01:02:03"), ("2004-02-29", "01:02:03.5"), ("2004-02-29", "01:02:03.123456")], "d string, t string")
    found = [x for (x,) in values(df.select(T.compose(F.col("d"), F.col("t")).alias("x")), "x")]
    assert found == [stamp("2004-02-29T01:02:03"), stamp("2004-02-29T01:02:03.5"), stamp("2004-02-29T01:02:03.123456")]
    assert values(df.limit(1).select(T.parse_compact(F.lit("200402290102")).alias("x")), "x") == [(stamp("2004-02-29T01:02"),)]
    with pytest.raises(Exception, match="CANNOT_PARSE|200413"):
        df.select(T.parse_compact(F.lit("200413290102"))).collect()
    assert [r.ym for r in T.month_spine(spark, "1999-12", "2000-02").collect()] == ["199912", "200001", "200002"]
    assert T.month_spine(spark, "1999-12", "1999-12").count() == 1
    for bad in (("2000-02", "1999-12"), ("2000-13", "2001-01"), ("2000-1", "2001-01"), ("x", "2001-01")):
        with pytest.raises(ValueError):
            T.month_spine(spark, *bad)


def test_names(spark):
    names = ["GA_DNS_ACC_2010_05_v02.zip", "X_2010-05.zip", "plain.zip", "XX_dns_2011_01_.zip", "readme.txt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [x for (x,) in values(df.select(X.year_month(F.col("name")).alias("ym")), "ym")] == [201005, 201005, None, 201101, None]
    pick = lambda *a: [r.name for r in catalog.select_files(df, *a).collect()]
    assert pick(["GA_"], 201001, 201012) == names[:1]
    assert pick(["CH_"]) == []
    assert pick(["CH_"], None, None, True) == [names[0], names[3]]
    pages = spark.createDataFrame([('<a href="../"><a href="sub/"><a href="b.zip"><a href="a.zip"><a href="b.zip">',)], "html string")
    assert [r.name for r in catalog.href_names(pages).collect()] == ["a.zip", "b.zip"]
    assert [r.name for r in catalog.listing_names(spark.createDataFrame([(" a \n\nb\r\n",)], "text string")).collect()] == ["a", "b"]
    paths = spark.createDataFrame([(p,) for p in ("x/tmp/a", "x/tmpfoo/a", "a/tmp/b", "y/a.csv")], "path string")
    assert values(catalog.without_dirs(paths, ["tmp"]), "path") == [("x/tmpfoo/a",)]
    assert catalog.sources(spark).groupBy("dataset").count().where("dataset in ('co2', 'space_weather')").count() == 2
    assert [r[0] for r in catalog.first_of(df).collect()] == ["GA_DNS_ACC_2010_05_v02.zip"]
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert one(X.url_tail(F.lit("http://a/b/c.txt//"))) == "c.txt" and one(X.url_tail(F.lit(""))) == "download.bin"
    assert one(X.strip_suffix(F.lit("CH_merged"), "_merged")) == "CH" and one(X.archive_code(F.lit("den_201202.txt"))) == "HASDM_2012"
    with pytest.raises(Exception, match="no year"):
        one(X.archive_code(F.lit("den.txt")))
    assert one(X.answer_parts(F.lit(" 200 text/plain; x http://a"))) == ["200", "text/plain;", "x http://a"]
    label = X.row_label(F.col("n"), F.lit(300400.0), F.lit(499600.0), F.lit("2001-05-01").cast("timestamp_ntz"), F.lit("2009-01-01").cast("timestamp_ntz"))
    assert [r[0] for r in spark.createDataFrame([("A",), ("B 1-2 km, x",)], "n string").select(label).collect()] == ["A 300-500 km, 2001-2009", "B 1-2 km, x"]


def test_text_reader(spark, tmp_path):
    good = "# head\n  # indented\n\n2005-01-01\t00:00:00.000 UTC 400000.0 1 2 3 4 5e-12 6 0 8\r\n\t2005-01-02 00:00:10.5 UTC 410000.0 1 2 3 4 5e-12 6 1 8\n"
    bad = good + "2005-01-03 00:00:00 UTC 1 2 3\n"
    worse = good.replace("410000.0", "high")
    for name, member, content in (("CH_a.zip", "CH_A.TXT", good), ("CH_b.zip", "b.txt", bad), ("CH_c.zip", "c.txt", worse), ("CH_d.zip", "notes.md", good)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, content)
    rows, rejected = read_mission(spark, f"{tmp_path}/CH_*.zip", SCHEMAS["CHAMP"])
    assert rows.count() == 2 and {r.path.rsplit("/", 1)[-1] for r in rows.collect()} == {"CH_a.zip"}
    assert {r.path.rsplit("/", 1)[-1] for r in rejected.collect()} == {"CH_b.zip", "CH_c.zip"}
    assert rows.schema["Altitude (m)"].dataType.simpleString() == "double"

    out = decode.decode_mission(spark, "champ", [f"{tmp_path}/CH_a.zip"], f"{tmp_path}/decoded", f"{tmp_path}/manifest")
    assert out.rejected.count() == 0
    merged = decode.merge_tables(spark, [out.path, out.path], f"{tmp_path}/CH_merged.parquet", f"{tmp_path}/merges")
    table = spark.read.parquet(merged)
    assert table.count() == 4 and "Time System" not in table.columns and "timestamp" in table.columns
    assert [r.timestamp for r in table.collect()][-1] == stamp("2005-01-02T00:00:10.5")
    assert [r.mission_code for r in tables.read_csv(spark, f"{tmp_path}/manifest", decode.DECODE_MANIFEST).collect()] == ["CH"]
    assert [r.mission_code for r in tables.read_csv(spark, f"{tmp_path}/merges", decode.MERGE_MANIFEST).collect()] == ["CH"]
    assert decode.merge_tables(spark, [], "x") is None
    out = decode.decode_mission(spark, "champ", [f"{tmp_path}/CH_{x}.zip" for x in "abc"], f"{tmp_path}/two", f"{tmp_path}/log")
    logged = tables.read_csv(spark, f"{tmp_path}/log", decode.DECODE_MANIFEST).collect()
    assert [r.source_path.rsplit("/", 1)[-1] for r in logged] == ["CH_a.zip"] and spark.read.parquet(out.path).count() == 2
    assert {r.path.rsplit("/", 1)[-1] for r in out.rejected.collect()} == {"CH_b.zip", "CH_c.zip"}
    with pytest.raises(ValueError, match="unknown mission"):
        decode.decode_mission(spark, "x", [], "y")
    with pytest.raises(ValueError):
        decode.decode_mission(spark, "champ", [f"{tmp_path}/CH_b.zip"], f"{tmp_path}/none")


def test_archive_reader(spark, tmp_path):
    (tmp_path / "den_201202").write_text(": head\n# more\n201202010300 1 0.4 10 20 3 1e-12\n201202010000 1 0.5 10 20 3 2e-12\n")
    out = decode.decode_archive(spark, [str(tmp_path / "den_201202")], f"{tmp_path}/out", f"{tmp_path}/log")
    rows = spark.read.parquet(out.path)
    assert [(r.timestamp.hour, r["Altitude (m)"]) for r in rows.collect()] == [(0, 500.0), (3, 400.0)]
    assert tables.read_csv(spark, f"{tmp_path}/log", decode.DECODE_MANIFEST).first().mission_code == "HASDM_2012"
    (tmp_path / "bad").write_text("201213010300 1 0.4 10 20 3 1e-12\n")
    with pytest.raises(Exception, match="PARSE"):
        read_archive(spark, str(tmp_path / "bad"))[0].collect()


def test_typed_rejects_by_key(spark):
    lines = spark.createDataFrame([("a", 0, "1 x"), ("b", 0, "y x")], "path string, line_no int, line string")
    from pyspark.sql import types as K

    schema = K.StructType([K.StructField("n", K.IntegerType()), K.StructField("s", K.StringType())])
    good, bad = typed(normalised(lines), schema)
    assert values(good, "path", "n", "s") == [("a", 1, "x")] and bad.count() == 1


def test_merge(spark):
    df = spark.createDataFrame([(1, "UTC"), (2, "GPS")], "x int, `Time System` string")
    assert "Time System" in merge.merge([df]).columns
    assert "Time System" in merge.collapse_constant(df.where("x = 1").union(spark.createDataFrame([(3, None)], df.schema)), "Time System").columns
    with pytest.raises(ValueError, match="other columns"):
        merge.strict_union([df, df.withColumn("x", F.col("x").cast("long"))])
    with pytest.raises(ValueError):
        merge.strict_union([])


def test_filters(spark):
    rows = [(stamp("2009-12-31"),), (stamp("2009-12-31T00:00:01"),), (stamp("2005-06-01"),), (stamp("2000-12-31"),), (stamp("2001-01-01"),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    kept = lambda flag: [r.t for r in df.where(filters.excluded_years(F.col("t"), flag)).collect()]
    assert kept(False) == [rows[1][0], rows[2][0], rows[4][0]] and kept(True) == [rows[1][0], rows[4][0]]
    band = spark.createDataFrame([(299999.9,), (300000.0,), (500000.0,), (500000.1,)], "a double")
    assert band.where(filters.altitude_band(F.col("a"), 300, 500)).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        filters.mission_filter("x")
    with pytest.raises(ValueError):
        filters.require_rows(band.limit(0), 1)


def _observations(spark):
    rows = [(stamp("2003-01-01T00:00"), 90.0, 0.1), (stamp("2003-01-01T12:00"), 90.0, 0.3), (stamp("2003-01-02"), 90.0, 0.5), (stamp("2003-03-01"), 120.0, None), (stamp("2003-06-01"), None, 1.0), (stamp("2003-01-03"), 95.0, None)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, f107a double, m double")


def test_modes(spark):
    binned = binstats.with_bins(_observations(spark))
    one = {m: {(r.bucket, r.seasonal_bin): r for r in binstats.figure_bins(binned, {"x": "m"}, m).collect()} for m in binstats.MODES}
    sem = one["uncertainty_of_mean"]
    assert set(sem) == {("<100", 0), ("100-160", 1)}
    assert sem["<100", 0].x_mean == pytest.approx(0.35) and sem["<100", 0]["count"] == 2
    assert sem["<100", 0].x_std == pytest.approx(0.15 * math.sqrt(2) / math.sqrt(2))
    assert sem["100-160", 1].x_mean is None and math.isnan(sem["100-160", 1].x_std)
    raw = one["raw_observation_uncertainty"]["<100", 0]
    assert raw.x_mean == pytest.approx(0.3) and raw.x_std == pytest.approx(0.2 / math.sqrt(3)) and raw["count"] == 3
    assert one["sample_std"]["100-160", 1].x_std == 0
    assert one["paper"]["<100", 0].x_std == pytest.approx(math.sqrt((0.01 + 0.09 + 0.25) / 3 - 0.09))
    with pytest.raises(ValueError):
        binstats.figure_bins(binned, {"x": "m"}, "other")
    with pytest.raises(ValueError, match="no such metric"):
        binstats.metric_columns(binned, {"x": "gone"})
    assert binstats.metric_columns(binned, {"x": "m", "y": "gone"}, ["y"]) == {"x": "m"}


def test_bin_stats_forms_agree(spark):
    binned = binstats.with_bins(_observations(spark)).where("bucket is not null")
    one, two = ({(r.bucket, r.seasonal_bin): r for r in f(binned, "m").collect()} for f in (binstats.bin_stats, binstats.bin_stats_joined))
    assert set(one) == set(two)
    for k in one:
        for name in one[k].asDict():
            a, b = one[k][name], two[k][name]
            assert a == b or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


def test_weather(spark):
    daily = spark.createDataFrame([(2003, 1, d, *[float(d)] * 8, 5.0, f, 111.0, "OBS") for d, f in ((1, 400.0), (2, 400.1), (5, 90.0))], SPACE_WEATHER)
    fixed = {r.DAY: (r.F107_OBS, r.F107_DATA_TYPE) for r in weather.replace_high_flux(daily).collect()}
    assert fixed == {1: (400.0, "OBS"), 2: (111.0, "INT"), 5: (90.0, "OBS")}
    dated = weather.with_day(daily)
    times = spark.createDataFrame([(stamp("2003-01-04T05:00"),)], "timestamp timestamp_ntz")
    assert sorted(r.DAY for r in weather.slice_around(dated, times).collect()) == [1, 2, 5]
    assert sorted(r.DAY for r in weather.slice_around(dated, times, before=0, after=1).collect()) == [5]
    with pytest.raises(ValueError):
        weather.slice_around(dated, times, before=0, after=0)
    calls = []

    def lookup(hours):
        calls.append(hours.count())
        return hours.withColumn("v", F.hour("hour"))

    many = spark.createDataFrame([(stamp("2003-01-01T05:10"),), (stamp("2003-01-01T05:50"),), (None,)], "timestamp timestamp_ntz")
    assert sorted(values(weather.lookup_by_hour(many, lookup), "v"), key=str) == [(5,), (5,), (None,)] and calls == [2]
    assert weather.ap_history(daily).count() == 24
    assert "AP1" in weather.pruned(daily).columns


def test_model_and_ratios(spark, tmp_path):
    rows = spark.createDataFrame(
        [(stamp(f"2003-01-0{d}T01:00"), 400000.0 * d, 1.0, 2.0, 2.0) for d in (2, 3)], "timestamp timestamp_ntz, `Altitude (m)` double, `Longitude (deg)` double, `Latitude (deg)` double, `Density (kg/m^3)` double"
    )
    daily = spark.createDataFrame([(2003, 1, d, *[float(d)] * 8, 7.0, 90.0 + d, 111.0, "OBS") for d in (1, 2, 3)], SPACE_WEATHER)
    source = f"{tmp_path}/CH_merged.parquet"
    rows.write.parquet(source)
    rows.limit(0).write.parquet(f"{tmp_path}/empty_merged.parquet")
    log = f"{tmp_path}/runs"
    sources = [source, f"{tmp_path}/empty_merged.parquet", f"{tmp_path}/gone_merged.parquet"]
    first = {r.source_file: r for r in generate.generate(spark, sources, closed_form, daily, log).collect()}
    assert [first[s].status for s in sources] == ["success", "failed", "failed"] and first[source].rows == 2
    again = {r.source_file: r for r in generate.generate(spark, sources, closed_form, daily, log).collect()}
    assert again[source].status == "skipped" and again[source].error == "manifest" and again[sources[1]].status == "failed"
    made = spark.read.parquet(generate.output_path(source)).orderBy("timestamp")
    assert made.first()["f107"] == 91.0 and made.first()["f107a"] == 111.0 and made.first()["ap"] == 7.0
    assert made.first()["msis_density_ct_2.0"] == pytest.approx(400 + 1 - 2 + 300 + 150)
    assert [r.status for r in generate.generate(spark, source, closed_form, daily, skip_existing=False).collect()] == ["success"]
    one = f"{tmp_path}/one"
    with pytest.raises(ValueError, match="no rows"):
        generate.generate(spark, sources[1], closed_form, daily, one)
    assert [r.status for r in tables.read_csv(spark, one, RUN_MANIFEST).collect()] == ["failed"]
    analysed = ratios.analysed(ratios.with_mission({"CHAMP": made}))
    assert "ln_density_ratio_2.1" in analysed.columns and "ln_density_ratio_matlab_density" not in analysed.columns
    with pytest.raises(ValueError, match="repeat"):
        ratios.assert_unique(rows.union(rows), ["timestamp"])


def test_pending_cases(spark):
    files = spark.createDataFrame([(s, f"o{s}") for s in "abcd"], "source_file string, output_file string")
    runs = spark.createDataFrame([(None, st, s, "", 1, 1, 1, 1.0, 1, 1, "") for s, st in (("a", "success"), ("a", "failed"), ("b", "success"), ("c", "failed"))], RUN_MANIFEST)
    outputs = spark.createDataFrame([("oa",), ("oc",)], "output_file string")
    todo, skipped = manifest.pending(files, runs, outputs)
    assert sorted(values(todo, "source_file")) == [("b",), ("d",)]
    assert sorted(values(skipped, "source_file", "reason")) == [("a", "manifest"), ("c", "output_exists")]
    todo, _ = manifest.pending(files, runs, outputs, resume=False, skip_existing=False)
    assert todo.count() == 4


def test_upsert_and_entries(spark, tmp_path):
    old = spark.createDataFrame([("p", 1, "x"), ("q", 1, "x")], "path string, seq int, v string")
    new = spark.createDataFrame([("p", 1, "y"), ("p", 2, "z")], "path string, seq int, v string")
    assert sorted(values(manifest.upsert(old, new), "path", "v")) == [("p", "z"), ("q", "x")]
    (tmp_path / "m.json").write_text('{"entries": [{"path": "a", "url": "u"}]}')
    rows = manifest.entries(tables.read_download_manifest(spark, str(tmp_path / "m.json"))).collect()
    assert [(r.dataset, r.status, r.path) for r in rows] == [("unknown", "unknown", "a")]
    assert tables.read_csv(spark, f"{tmp_path}/none", RUN_MANIFEST).count() == 0
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert one(manifest.download_needed(F.lit(True), F.lit(0), False)) and not one(manifest.download_needed(F.lit(True), F.lit(5), False))
    assert one(manifest.valid_response(F.lit("http://a"), F.lit("text/plain"), F.lit(200))) and not one(manifest.valid_response(F.lit("http://login.a.org/x"), F.lit("text/plain"), F.lit(200)))
    assert one(manifest.valid_response(F.lit("http://a/login"), F.lit("text/plain"), F.lit(200))) and not one(manifest.valid_response(F.lit("http://a"), F.lit("text/html; charset=x"), F.lit(200)))


def test_no_page_is_stored_as_a_file(tmp_path):
    page, data = tmp_path / "error.html", tmp_path / "data.bin"
    page.write_text("<p>Sorry</p>")
    data.write_bytes(b"data")
    answers = [download.download(f.as_uri(), tmp_path / "out" / f.name, retries=1) for f in (page, data)]
    assert [a.status for a in answers] == ["failed", "downloaded"] and not (tmp_path / "out" / "error.html").exists()
    assert download.first_answer([page.as_uri()]) == b"<p>Sorry</p>"


def test_downloads(tmp_path):
    asked, naps = [], []

    def get(url):
        asked.append(url)
        if "bad" in url:
            raise OSError("no")
        return b"data"

    files = [(u, tmp_path / u) for u in ("a", "bad", "b")]
    assert [e.status for e in download.download_all(files, retries=2, delay_s=0, get=get)] == ["downloaded", "failed", "downloaded"]
    assert asked.count("bad") == 2
    out = download.download_slowly(files, 65, naps.append, retries=1, delay_s=0, get=get)
    assert [e.status for e in out] == ["skipped", "failed", "skipped"] and naps == [65]
    assert download.first_answer(["bad", "x"], get) == b"data"
    with pytest.raises(OSError):
        download.first_answer(["bad"], get)


class Server:
    """Answers by path, with the code, kind and body of ``files``, and goes on at an offset if asked to."""

    def __init__(self, files):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from threading import Thread

        self.asked, outer = [], self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                outer.asked.append((self.path, dict(self.headers)))
                code, kind, body = files.get(self.path, (404, "text/plain", b"gone"))
                if code == 200 and "Range" in self.headers:
                    at = int(self.headers["Range"].split("=")[1].rstrip("-"))
                    code, body = (206, body[at:]) if at < len(body) else (416, b"")
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def served():
    files = {"/a.zip": (200, "application/zip", b"0123456789"), "/page": (200, "text/html", b"<p>Sign in</p>"), "/empty": (200, "text/plain", b"")}
    files["/index/"] = (200, "text/html", b'<a href="GA_DNS_ACC_2002_01_v02.zip"><a href="GA_DNS_ACC_2003_01_v02.zip"><a href="sub/"><a href="x.txt">')
    files |= {f"/index/GA_DNS_ACC_{y}_01_v02.zip": (200, "application/zip", b"z") for y in (2002, 2003)}
    files |= {f"/{y}/{m}": (200, "application/octet-stream", b"rows") for y, m in (("2000", "12"), ("2001", "01"))}
    server = Server(files)
    yield server
    server.server.shutdown()


def test_answers_that_are_no_files(served, tmp_path):
    """HTML, an empty body and an error are failures, and leave nothing at the file's place."""
    for name in ("page", "empty", "none"):
        entry = download.download(f"{served.url}/{name}", tmp_path / name, retries=2, delay_s=0)
        assert entry.status == "failed" and entry.error and not (tmp_path / name).exists()
    assert download.is_login("https://LOGIN.example.org/x") and not download.is_login("https://example.org/login")


def test_resume_and_credentials(served, tmp_path):
    (tmp_path / "a.zip.part").write_bytes(b"01234")
    client = download.Client(cookie="s=1", user="u", password="p", headers={"X-A": "b"})
    entry = download.download(f"{served.url}/a.zip", tmp_path / "a.zip", client=client)
    asked = served.asked[-1][1]
    assert entry.size_bytes == 10 and (tmp_path / "a.zip").read_bytes() == b"0123456789" and asked["Range"] == "bytes=5-" and asked["Cookie"] == "s=1" and asked["X-A"] == "b" and asked["Authorization"].startswith("Basic ")
    (tmp_path / "b.part").write_bytes(b"0123456789")
    assert download.download(f"{served.url}/a.zip", tmp_path / "b", client=client).size_bytes == 10
    (tmp_path / "jar").write_text("# Netscape HTTP Cookie File\n127.0.0.1\tFALSE\t/\tFALSE\t0\tsession\tabc\n")
    download.download(f"{served.url}/a.zip", tmp_path / "c", client=download.Client(cookie_file=str(tmp_path / "jar"), bearer="t", resume=False))
    assert served.asked[-1][1]["Cookie"] == "session=abc" and served.asked[-1][1]["Authorization"] == "Bearer t"


def test_archive_in_months(served, tmp_path, monkeypatch):
    import json

    monkeypatch.setattr(download.catalog, "ARCHIVE", served.url)
    naps = []
    entries = download.fetch_archive(tmp_path / "archive", "2000-11", "2001-01", 65, sleep=naps.append, retries=1)
    assert [e.status for e in entries] == ["failed", "downloaded", "downloaded"] and naps == [65, 65] and "cookie" in entries[0].error
    naps.clear()
    again = download.fetch_archive(tmp_path / "archive", "2000-12", "2001-01", 65, sleep=naps.append, retries=1)
    assert [e.status for e in again] == ["skipped", "skipped"] and not naps
    known = json.loads((tmp_path / "archive" / "manifest.json").read_text())
    assert known["dataset"] == "hasdm" and [(e["path"], e["status"]) for e in known["entries"]] == [("hasdm_2000_11", "failed"), ("hasdm_2000_12", "skipped"), ("hasdm_2001_01", "skipped")]
    with pytest.raises(ValueError):
        download.fetch_archive(tmp_path, "2001-02", "2001-01")


def test_missions_from_their_index(spark, served, tmp_path, monkeypatch):
    monkeypatch.setattr(download.catalog, "DENSITY_FOLDER", served.url + "/")
    monkeypatch.setattr(download.catalog, "MISSIONS", {"grace": (["gone/", "index/"], ["GA_DNS_ACC_"], False), "goce": (["gone/"], ["GO_"], True)})
    entries = download.fetch_missions(spark, tmp_path, ["grace", "goce"], 200201, 200212, retries=1)
    assert [(e.path.rsplit("/", 1)[-1], e.status) for e in entries] == [("goce", "failed"), ("GA_DNS_ACC_2002_01_v02.zip", "downloaded")]
    rows = manifest.entries(tables.read_download_manifest(spark, str(tmp_path / "manifest.json"))).collect()
    assert {(r.path, r.status) for r in rows} == {("goce", "failed"), ("grace/GA_DNS_ACC_2002_01_v02.zip", "downloaded")}
    monkeypatch.setattr(download.catalog, "SPACE_WEATHER", {"a.txt": served.url + "/a.zip"})
    assert download.main(["space_weather", "--folder", str(tmp_path / "sw")]) == 0 and (tmp_path / "sw" / "a.txt").exists()


def test_tables_are_replaced_whole(spark, tmp_path):
    """A plan may read the table that it replaces; one that fails leaves it."""
    path = f"{tmp_path}/t"
    tables.write(spark.range(3), path)
    tables.write(spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(values(spark.read.parquet(path), "id")) == [(10,), (11,), (12,)]
    with pytest.raises(Exception, match="no"):
        tables.write(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_days_that_repeat(spark):
    rows = spark.createDataFrame([(stamp("2003-01-02"),)], "timestamp timestamp_ntz")
    daily = spark.createDataFrame([(dt.date(2003, 1, 2), 1.0), (dt.date(2003, 1, 2), 2.0)], "date date, x double")
    assert weather.attach_daily(rows, daily.limit(1)).first().x == 1.0
    with pytest.raises(Exception, match="repeats"):
        weather.attach_daily(rows, daily).collect()


def test_figure_command(spark, tmp_path):
    rows = figure.sample_observations(spark, 300).withColumns({"Anomalus Density (kg/m^3)": F.lit(0.0), "Degraded Flag Thrusters": F.lit(0.0)})
    rows.write.parquet(f"{tmp_path}/t")
    assert figure.main([f"CHAMP={tmp_path}/t", "--folder", f"{tmp_path}/out"]) == 0
    for name, _, _ in figure.VARIANTS:
        assert spark.read.parquet(f"{tmp_path}/out/{name}/points").count() > 0 and spark.read.parquet(f"{tmp_path}/out/{name}/labels").count() == 1


def test_figure_and_report(spark, tmp_path):
    rows = [(stamp(f"2003-{m:02d}-0{d}"), 350000.0 if name == "C" else 250000.0, 80.0 + 30 * d, 0.0, 0.0, 0.1 * d, 0.2 * m) for name in "CG" for m in range(1, 13) for d in (1, 2, 3)]
    table = spark.createDataFrame(
        rows, "timestamp timestamp_ntz, `Altitude (m)` double, f107a double, `Anomalus Density (kg/m^3)` double, `Degraded Flag Thrusters` double, `ln_density_ratio_0` double, `ln_density_ratio_2.0` double"
    )
    table.write.parquet(f"{tmp_path}/t")
    made = figure.comparisons(spark, {"CHAMP": f"{tmp_path}/t", "GOCE": f"{tmp_path}/t"})
    assert len(made) == 3
    points, labels = made["daily_mean_sem_from_2006"]
    assert {r.label for r in labels.collect()} == {"CHAMP 350-350 km, 2003-2003", "GOCE 250-250 km, 2003-2003"}
    assert points.where("seasonal_bin not between 0 and 11").count() == 0 and points.count() > 0
    tables_ = stats.report(spark, "CHAMP", f"{tmp_path}/t", "ln_density_ratio_2.0", False)
    assert tables_["summary"].first().rows == 36 and tables_["maxima"].count() == 2
    with pytest.raises(ValueError, match="no such metric"):
        stats.report(spark, "CHAMP", f"{tmp_path}/t", "gone", False)
    assert stats.main([f"CHAMP={tmp_path}/t", "--metric", "ln_density_ratio_0"]) == 0


def test_sample_observations(spark):
    rows = figure.sample_observations(spark, 500)
    points, labels = figure.figure_data({"demo": rows})
    assert points.agg(F.sum("count")).first()[0] > 0 and labels.first().label == "demo 300-400 km, 2003-2003"
    assert rows.count() == 500 and rows.where("timestamp < timestamp_ntz '2003-01-01' or timestamp >= timestamp_ntz '2004-01-01'").count() == 0


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": range(25)}), tmp_path / "t.parquet", row_group_size=10)
    groups = tables.row_groups(spark, str(tmp_path))
    assert sorted(values(groups, "rows")) == [(5,), (10,), (10,)]
    assert manifest.batch_estimate(groups, batch=4).first().batches == 3 + 3 + 2


def test_stream(spark, tmp_path):
    from orbiteer.streaming.daily import daily_means

    _observations(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("timestamp timestamp_ntz, f107a double, m double").parquet(f"{tmp_path}/in")
    q = daily_means(stream, {"x": "m"}).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.date_bin: r.x for r in spark.table("days").collect()}
    assert got[dt.date(2003, 1, 1)] == pytest.approx(0.2) and len(got) == 5


def test_zip_without_text(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.md", "x")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    rows, bad = read_mission(spark, str(tmp_path), SCHEMAS["CHAMP"])
    assert rows.count() == 0 and bad.count() == 0


def test_model_on_an_empty_table(spark):
    df = spark.createDataFrame([], "timestamp timestamp_ntz, `Altitude (m)` double, `Longitude (deg)` double, `Latitude (deg)` double, f107 double, f107a double, aps array<double>")
    assert model.add_densities(df, closed_form).count() == 0


def test_space_weather_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("AP2,F10.7_OBS,DATE,X,F10.7_DATA_TYPE\n7,71.5,1957-10-01,1,OBS\nbad,,1957-10-02,,\n")
    rows = [r.asDict() for r in tables.read_space_weather(spark, str(tmp_path / "a.csv")).orderBy("DAY").collect()]
    assert [(r["YEAR"], r["MONTH"], r["DAY"], r["AP1"], r["AP2"], r["F107_OBS"], r["F107_DATA_TYPE"]) for r in rows] == [(1957, 10, 1, None, 7.0, 71.5, "OBS"), (1957, 10, 2, None, None, None, None)]
    (tmp_path / "b.csv").write_text("DAY,MONTH,YEAR,AP_AVG\n3,2,2001,4\n")
    assert [(r.YEAR, r.MONTH, r.DAY, r.AP_AVG) for r in tables.read_space_weather(spark, str(tmp_path / "b.csv")).collect()] == [(2001, 2, 3, 4.0)]
    (tmp_path / "c.csv").write_text("AP1\n3\n")
    with pytest.raises(ValueError, match="no days"):
        tables.read_space_weather(spark, str(tmp_path / "c.csv"))
    # a header that differs isn't read by position
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_space_weather(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()


def test_answers(spark):
    lines = [("a", 5, "200 application/zip http://x/a b"), ("b", 0, "200 application/zip http://x"), ("c", 5, "200 TEXT/html http://x"), ("d", 5, "503 a/b http://x"), ("e", 5, "200 a/b https://LOGIN.x.org/"), ("f", 5, "200 a/b"), ("g", None, ""), ("h", 5, None), ("i", 5, "200 a/b " + "http://x/" + "y" * 500), ("j", 5, "5xx a/b " + "y" * 500)]
    rows = {r.path: r for r in manifest.answered(spark.createDataFrame(lines, "path string, size int, line string")).collect()}
    assert {p: r.status for p, r in rows.items()} == {p: "downloaded" if p in "ai" else "failed" for p, _, _ in lines}
    assert (rows["a"].url, rows["a"].size_bytes, rows["a"].error) == ("http://x/a b", 5, None) and rows["b"].error == "empty answer"
    assert len(rows["j"].error) == 200 and rows["h"].error == "not a file: " and rows["f"].url == ""
    assert dt.datetime.now(dt.UTC) - dt.datetime.fromisoformat(rows["a"].timestamp) < dt.timedelta(minutes=10)
    own = manifest.answered(spark.createDataFrame(lines[:1], "path string, size int, line string"), F.lit("t")).first()
    assert own.timestamp == "t" and own.asDict().keys() == {f.name for f in DOWNLOAD_ENTRY.fields}


def test_fetch_plan(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, n int")
    there = spark.createDataFrame([("a", 0), ("a", 9), ("b", 0), ("c", None), ("z", 1)], "path string, size int")
    assert sorted(values(manifest.fetch_plan(wanted, there), "path", "n", "needed")) == [("a", 1, False), ("b", 2, True), ("c", 3, True), ("d", 4, True)]
    assert all(r.needed for r in manifest.fetch_plan(wanted, there, overwrite=True).collect())
    assert manifest.fetch_plan(wanted, there.limit(0)).where("needed").count() == 4
