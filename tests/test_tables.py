"""Files streamed, tables committed, merged by footers, laid out by key, and generated as one plan."""

import datetime as dt
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from orbiteer.operators import merge, ratios, weather
from orbiteer.plans import decode, generate, merge_sorted
from orbiteer.queries import closed_form
from orbiteer.schemas import RUN_MANIFEST, SCHEMAS, SPACE_WEATHER
from orbiteer.sources import archive, layout, tables
from orbiteer.sources.commits import LOG, CommittedTable
from orbiteer.sources.text import judged, normalised, read_lines, typed, verdicts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted(r[0] for r in df.collect())


# files


@pytest.mark.parametrize("split", [40, 97, 1 << 20])
def test_ranges_of_text_have_each_line_once(spark, tmp_path, split):
    lines = [f"line {i}" + "é" * (i % 7) for i in range(200)] + ["", "last\r", "a\rb"]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    rows = sorted(archive.stream_lines(spark, str(tmp_path), split).collect(), key=lambda r: (r.offset, r.line_no))
    assert [r.line for r in rows] == lines[:-2] + ["last", "a", "b"]
    assert {r.member for r in rows} == {"a.txt"} and len({r.offset for r in rows}) == (1 if split > 5000 else -(-(tmp_path / "a.txt").stat().st_size // split))


def test_broken_files_are_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.md", "x")
        z.writestr("B.TXT", "\n".join(f"row {i}" for i in range(50_000)))
        z.writestr("c.txt", "not this one")
    raw = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(b"PK\x03\x04" + raw[4:2000])
    (tmp_path / "mid.zip").write_bytes(raw[:60_000] + bytes(500) + raw[60_500:])
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.md", "x")
    (tmp_path / "empty.txt").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[-1]: r for r in archive.stream_lines(spark, str(tmp_path)).groupBy("path").agg(F.max("member").alias("member"), F.count("line").alias("lines"), F.max("error").alias("error")).collect()}
    assert found["good.zip"].lines == 50_000 and found["good.zip"].member == "B.TXT" and found["good.zip"].error is None
    assert found["mid.zip"].error and "BadZipFile" in found["cut.zip"].error and found["none.zip"].member is None and found["none.zip"].error is None
    assert "empty.txt" not in found
    with pytest.raises(Exception, match="gone"):
        archive.stream_lines(spark, str(tmp_path / "gone.zip")).collect()


def test_small_inputs_reach_all_tasks(tmp_path, monkeypatch):
    """Ranges are shorter where there would be fewer of them than tasks, and a zip stays whole."""
    monkeypatch.setattr(archive, "LEAST", 1000)
    (tmp_path / "a.txt").write_bytes(b"x" * 9_999 + b"\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.txt", "y" * 6_000)
    size = (tmp_path / "b.zip").stat().st_size
    for tasks, most in ((1, 10_000 + size), (4, (10_000 + size) // 4), (1000, 1000)):
        parts = archive.Lines([str(tmp_path)], 1 << 20, tasks).partitions()
        ranges = sorted(r for p in parts for r in p.ranges)
        own = [(a, b) for path, a, b in ranges if path.endswith("a.txt")]
        assert own[0][0] == 0 and own[-1][1] == 10_000 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert max(b - a for a, b in own) <= most and len(parts) >= min(tasks, 10)
        assert [r[1:] for r in ranges if r[0].endswith("b.zip")] == [(0, size)]
    assert len(archive.Lines([str(tmp_path)], 500, 1).partitions()) >= 20


def test_zips_count_by_their_text(tmp_path):
    """A task gets fewer bytes of zips than of plain text, in whatever order they are listed."""
    for i in range(12):
        (tmp_path / f"{i:02}{'.zip' if i % 3 == 0 else '.txt'}").write_bytes((b"PK\x03\x04" if i % 3 == 0 else b"text") + bytes(9_996))
    parts = archive.Lines([str(tmp_path)], 100_000).partitions()
    zips = [sum(path.endswith(".zip") for path, _, _ in p.ranges) for p in parts]
    assert sum(len(p.ranges) for p in parts) == 12 and sum(zips) == 4 and max(zips) <= 2


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_of_text_keep_line_ends(tmp_path, monkeypatch, block):
    """Lines end where they do when they are read one by one, whatever the blocks; what precedes a failure stays."""
    monkeypatch.setattr(archive, "BLOCK", block)
    raw = "a\r\n\r\nb\rc\n\n é\u2028x\n".encode() + b"\xff\xc3\nlast\r\r\n" + b"long" * 5000 + b"\nend"
    (tmp_path / "a.txt").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.txt", raw)
    (tmp_path / "c.zip").write_bytes((tmp_path / "b.zip").read_bytes().replace(b"\nend", b"\nEND"))
    read = lambda name: [x for b in archive._file(str(tmp_path / name), 0, len(raw)) for x in b.to_pylist()]
    plain, packed, broken = read("a.txt"), read("b.zip"), read("c.zip")
    kept = ["a", "", "b", "c", "", " é\u2028x", "\ufffd\ufffd", "last"]
    assert [r["line"] for r in plain] == [*kept, "long" * 5000, "end"]
    assert [r["line"] for r in packed] == [*kept, "", "long" * 5000, "end"]
    assert [r["line_no"] for r in packed] == list(range(11)) and {r["error"] for r in plain + packed} == {None}
    assert "CRC" in broken[-1]["error"] and [r["line"] for r in broken[:-1]] == [r["line"] for r in packed[: len(broken) - 1]] and len(broken) > 8


def test_stream_and_whole_files_agree(spark, tmp_path):
    folder = f"{tmp_path}/zips"
    made = archive.write_archives(spark.range(10_000).select(F.concat(F.lit("row "), "id")).repartition(3), folder)
    assert len(made) == 3 and sorted(os.listdir(folder)) == ["part-00000.zip", "part-00001.zip", "part-00002.zip"]
    streamed = archive.stream_lines(spark, f"{folder}/*.zip").where("line <> ''").select("member", "line").collect()
    whole = read_lines(spark, folder).where("line <> ''").select("member", "line").collect()
    assert sorted(streamed) == sorted(whole) and len(whole) == 10_000


def test_large_member_in_bounded_memory(tmp_path):
    """A member of 60 MB, unpacked, is read with a few MB."""
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("a.txt", "w", force_zip64=True) as out:
        for _ in range(60):
            out.write(b"0123456789 0123456789 abc\n" * 40_330)
    tracemalloc.start()
    rows = sum(b.num_rows for b in archive._file(str(tmp_path / "a.zip"), 0, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60 * 40_330 and peak < 24 << 20


ROW = "2005-01-0{} 00:00:10.5 UTC 410000.0 1 2 3 4 5e-12 6 0 8\n"


def test_verdicts(spark, tmp_path):
    good = "# head\n" + ROW.format(1) + ROW.format(2)
    for name, text in (("CH_good.txt", good), ("CH_bad.txt", good + "1 2 3\n"), ("CH_blank.txt", "# only\n\n"), ("CH_type.txt", good.replace("410000.0", "high"))):
        (tmp_path / name).write_text(text)
    with zipfile.ZipFile(tmp_path / "CH_none.zip", "w") as z:
        z.writestr("a.md", "x")
    rows = judged(archive.stream_lines(spark, str(tmp_path)), SCHEMAS["CHAMP"])
    found = {r.path.rsplit("_", 1)[-1]: (r.status, r.rows, r.bad_rows) for r in verdicts(rows).collect()}
    assert found == {"good.txt": ("decoded", 2, 0), "bad.txt": ("rejected", 2, 1), "blank.txt": ("empty", 0, 0), "type.txt": ("rejected", 0, 2), "none.zip": ("no_text", 0, 0)}
    out = decode.decode_mission(spark, "champ", [f"{tmp_path}/CH_*"], f"{tmp_path}/out/t", f"{tmp_path}/out/log")
    assert spark.read.parquet(out.path).count() == 2 and {r.status for r in out.files.collect()} == {"decoded", "rejected", "empty", "no_text"}
    assert sorted(os.listdir(tmp_path / "out")) == ["log", "t", "t-files", "t-rejected"]


def test_lines_are_split_once(spark):
    """Neither what is dropped nor the types of columns make the tokens again; verdicts count without sorting rows by path."""
    data = [(0, "# c"), (1, " \t# c"), (2, " \t\x0b "), (3, "\u2028"), (4, ROW.format(1)), (5, "\u00a0# c"), (6, "x\n#"), (7, None), (8, "")]
    lines = spark.createDataFrame([("p", "m", 0, i, line, None) for i, line in data], "path string, member string, offset long, line_no long, line string, error string")
    rows = judged(lines, SCHEMAS["CHAMP"])
    assert plan(rows).count("split(") == 1
    assert {r.line_no: r.kind for r in rows.collect()} == {0: "blank", 3: "bad", 4: "row", 5: "bad", 6: "bad"}
    assert plan(verdicts(rows)).count("HashAggregate") >= 2
    good, bad = typed(normalised(lines), SCHEMAS["CHAMP"])
    assert plan(bad).count("split(") == 1 and sorted(r.line_no for r in bad.collect()) == [3, 5, 6] and good.count() == 0


# commits


def test_versions_stay_readable(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t")
    assert t.replace(spark.range(3)) == 0 and t.append(spark.range(10, 12)) == 1
    reader = t.read()
    assert t.replace(t.read().where("id < 2")) == 2
    assert ids(reader) == [0, 1, 2, 10, 11] and ids(t.read()) == [0, 1] and ids(t.read(0)) == [0, 1, 2]
    assert ids(tables.scan(spark, f"{tmp_path}/t")) == [0, 1]
    assert t.vacuum() == [] and len(t.vacuum(0)) == 2 and ids(t.read()) == [0, 1]
    with pytest.raises(ValueError, match="no version"):
        t.read(7)
    with pytest.raises(ValueError, match="no schema"):
        CommittedTable(spark, f"{tmp_path}/none").read()


def test_a_writer_that_stops_leaves_no_trace(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t")
    t.append(spark.range(2))
    with pytest.raises(Exception, match="stop"):
        t.append(spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id")))
    t._data(spark.range(5), False)  # written, never committed
    assert ids(t.read()) == [0, 1] and t.version() == 0
    t.vacuum(0)
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("data-")]) == 1


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder, n, errors = f"{tmp_path}/t", 6, []

    def writer(i):
        try:
            for j in range(3):
                CommittedTable(spark, folder).append(spark.createDataFrame([(10 * i + j,)], "id long"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    CommittedTable(spark, folder).compact()
    [t.join() for t in threads]
    t = CommittedTable(spark, folder)
    assert not errors and ids(t.read()) == [10 * i + j for i in range(n) for j in range(3)]
    assert [c.number for c in t.commits()] == list(range(len(t.commits())))


def test_only_one_takes_a_number(spark, tmp_path):
    store = CommittedTable(spark, f"{tmp_path}/t").store
    won, barrier = [], threading.Barrier(8)

    def take(i):
        barrier.wait()
        won.append(store.create(str(i), LOG, "000000000000.json"))

    threads = [threading.Thread(target=take, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1 and store.names(LOG) == ["000000000000.json"]


def test_compaction(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t")
    for i in range(4):
        t.append(spark.range(i, i + 1))
    t.compact()
    assert len(t.folders()) == 1 and ids(t.read()) == [0, 1, 2, 3] and ids(t.read(1)) == [0, 1]
    version, data = t.version(), t._data(spark.range(100, 101), False)
    t.append(spark.range(4, 5))
    t.replace(spark.range(7, 8))
    t.append(spark.range(8, 9))
    # one that began before the replacement: its rows may not come back
    late = CommittedTable(spark, f"{tmp_path}/t")
    late.version = iter([version, 7, 7, 7]).__next__
    late._data = lambda *_: data
    late.compact()
    assert ids(t.read()) == [7, 8]


def test_manifests_are_committed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT", 3)
    path, row = f"{tmp_path}/log", ("t", "success", "a,\"b\"", "o", 1, 2, 3, 0.5, 4, 1, None)
    for i in range(5):
        tables.append_csv(spark.createDataFrame([(*row[:4], i, *row[5:])], RUN_MANIFEST).withColumn("other", F.lit(1)), path, RUN_MANIFEST)
    got = tables.read_csv(spark, path, RUN_MANIFEST)
    assert sorted(map(tuple, got.collect())) == [(*row[:4], i, *row[5:]) for i in range(5)] and got.schema == RUN_MANIFEST
    assert len(CommittedTable(spark, path, RUN_MANIFEST, "csv", header="true").folders()) < 4
    spark.createDataFrame([row], RUN_MANIFEST).write.option("header", True).csv(f"{tmp_path}/old")
    tables.append_csv(spark.createDataFrame([row], RUN_MANIFEST), f"{tmp_path}/old", RUN_MANIFEST)
    assert tables.read_csv(spark, f"{tmp_path}/old", RUN_MANIFEST).count() == 2


@pytest.mark.parametrize("new,rows", [(True, [5, 6]), (False, [0, 1, 2])])
def test_a_stop_between_renames(spark, tmp_path, new, rows):
    path = f"{tmp_path}/t"
    tables.write(spark.range(3), path)
    os.rename(path, f"{path}-old-{'0' * 32}")
    if new:
        spark.range(5, 7).write.parquet(f"{path}-new-{'1' * 32}")
    else:  # still being written
        os.mkdir(f"{path}-new-{'1' * 32}")
    assert ids(tables.scan(spark, path)) == rows
    tables.write(spark.range(1), path)
    assert ids(tables.scan(spark, path)) == [0]


# merging


def decoded(spark, folder, months, system="UTC"):
    paths = []
    for m in months:
        rows = [(dt.date(2004, m, d), f"{h:02d}:00:00.{m:03d}", system, float(d)) for d in (9, 3, 27, 14) for h in (5, 1)]
        spark.createDataFrame(rows, "`Date yyyy-mm-dd` date, `Time hh:mm:ss.sss` string, `Time System` string, x double").coalesce(1).write.parquet(f"{folder}/m{m}_{len(paths)}")
        paths.append(f"{folder}/m{m}_{len(paths)}")
    return paths


def in_order(folder):
    import pyarrow.parquet as pq

    return [t for name in sorted(os.listdir(folder)) if name.endswith(".parquet") for t in pq.read_table(f"{folder}/{name}")["timestamp"].to_pylist()]


@pytest.mark.parametrize("months,sorted_groups", [([3, 1, 2, 12], 0), ([3, 1, 3, 2], 1), ([1], 0)])
def test_merge_by_footers(spark, tmp_path, months, sorted_groups):
    paths = decoded(spark, tmp_path, months)
    groups = merge_sorted.merge_sorted(spark, paths, f"{tmp_path}/out")
    plain = merge.merge([spark.read.parquet(p) for p in paths])
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sum(g.sorts for g in groups) == sorted_groups and len(groups) == len(set(months))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(got.columns).collect())) and set(got.columns) == set(plain.columns)
    times = in_order(tmp_path / "out")
    assert times == sorted(times) and len(times) == 8 * len(months)
    assert [n for n in os.listdir(tmp_path) if "stage" in n] == []
    merge_sorted.merge_sorted(spark, [f"{tmp_path}/out"], f"{tmp_path}/again")  # of tables that have a timestamp
    assert in_order(tmp_path / "again") == times


def test_files_in_order_are_not_shuffled(spark, tmp_path):
    paths = decoded(spark, tmp_path, [1, 2, 3])
    files = [p for folder in paths for p, _ in archive.listed(folder) if p.endswith(".parquet")]
    groups = [merge_sorted.Group((p,), False) for p in files] + [merge_sorted.Group(tuple(files), True)]
    assert "Exchange hashpartitioning" not in plan(merge_sorted._staged(spark, groups, True, False)) and "rangepartitioning" not in plan(merge_sorted._staged(spark, groups, True, False))
    assert "rangepartitioning" in plan(merge_sorted._staged(spark, groups, True, True))


def test_merge_keeps_two_time_systems(spark, tmp_path):
    paths = decoded(spark, tmp_path / "a", [1]) + decoded(spark, tmp_path / "b", [2], "GPS")
    merge_sorted.merge_sorted(spark, paths, f"{tmp_path}/out")
    assert "Time System" in spark.read.parquet(f"{tmp_path}/out").columns


def test_groups():
    of = lambda *files: [(set(g.paths), g.sorts) for g in merge_sorted.groups(files)]
    assert of(("b", 5, 6, True), ("a", 1, 4, True)) == [({"a"}, False), ({"b"}, False)]
    assert of(("a", 1, 9, True), ("b", 2, 3, True), ("c", 9, 9, True), ("d", 10, 10, False)) == [({"a", "b", "c"}, True), ({"d"}, True)]
    assert of(("a", None, None, True), ("b", 1, 2, True)) == [({"a", "b"}, True)] and of() == []


# layouts


def test_bucketed_join_moves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.lit("X").alias("mission"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), (F.col("id") + 1.0).alias("msis_density_0"), F.lit(2.0).alias("Density (kg/m^3)"))
    second = rows.where("extract(second from timestamp) % 3 <> 0").select("mission", "timestamp", F.lit(4.0).alias("matlab_density"), F.lit(0.0).alias("Altitude_m_"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ratios.write_bucketed(rows, "model_b", 4)
        ratios.write_bucketed(second, "second_b", 4)
        out = ratios.analysed_tables(spark, "model_b", "second_b")
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        assert "Exchange" in plan(ratios.analysed(rows, second))
        columns = ["timestamp", "`ln_density_ratio_0`", "ln_density_ratio_matlab_density"]
        assert sorted(out.select(columns).collect(), key=str) == sorted(ratios.analysed(rows, second).select(columns).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table if exists model_b")
        spark.sql("drop table if exists second_b")


def test_months_prune_files(spark, tmp_path):
    start = dt.date(2003, 1, 1)
    days = spark.createDataFrame([(start + dt.timedelta(i), float(i), "A" if i % 2 else "B") for i in range(900)], "date date, v double, mission string")
    layout.write_by_month(days, f"{tmp_path}/t", "date")
    table = layout.read_by_month(spark, f"{tmp_path}/t")
    assert table.count() == 900 and len(table.select("_metadata.file_path").distinct().collect()) == 60
    times = spark.createDataFrame([(dt.datetime(2003, 5, 2, 7),), (dt.datetime(2003, 6, 1),), (None,)], "timestamp timestamp_ntz").where("timestamp > timestamp_ntz'2003-01-05'")
    got = weather.slice_by_month(table, times)
    assert "dynamicpruning" in plan(got)
    want = weather.slice_around(days, times)
    assert sorted(map(tuple, got.select("date", "v").collect())) == sorted(map(tuple, want.select("date", "v").collect()))
    pruned = layout.months_between(table.where("mission = 'A'"), "2003-02", "2003-03")
    assert "PartitionFilters: [isnotnull(mission" in plan(pruned) and pruned.count() == 30
    with pytest.raises(ValueError):
        weather.slice_by_month(table, times.select(F.col("timestamp") + F.expr("interval 20 years")).toDF("timestamp"))


@pytest.mark.parametrize("stretch", [7, 50, 730])
def test_stretches_with_edges_equal_one_window(spark, stretch):
    from pyspark.sql.window import Window

    start = dt.date(2003, 1, 1)
    days = spark.createDataFrame([(start + dt.timedelta(i), float(i * i % 97)) for i in range(500) if i % 11 and not 200 < i < 300] + [(None, 5.0), (None, 7.0)], "date date, v double")
    whole = days.withColumn("m", F.avg("v").over(Window.orderBy(F.unix_date("date")).rangeBetween(-40, 40)))
    got = weather.centred_mean(days, "v", stretch=stretch)
    assert got.columns == ["date", "v", "v_81day_avg"] and "SinglePartition" not in plan(got)
    close = lambda rows: sorted((str(a), b, round(m, 9)) for a, b, m in rows)
    assert close(got.collect()) == close(whole.collect())
    daily = spark.createDataFrame([(2003, 1 + i // 28, 1 + i % 28, *[float(i + j) for j in range(8)], 5.0 + i, 90.0, 111.0, "OBS") for i in range(60)], SPACE_WEATHER)
    slots = weather.three_hourly(daily)
    over = Window.orderBy("slot")
    at = lambda a, b: F.avg("ap").over(over.rangeBetween(a, b))
    want = slots.select("slot", F.array("ap_day", "ap", at(-1, -1), at(-2, -2), at(-3, -3), at(-11, -4), at(-19, -12)).alias("aps"))
    history = weather.ap_history(daily, stretch)
    assert "SinglePartition" not in plan(history)
    assert sorted(map(str, history.collect())) == sorted(map(str, want.collect()))


# generation


def test_many_files_are_one_plan(spark, tmp_path):
    stamp = dt.datetime(2003, 1, 2, 1)
    schema = "timestamp timestamp_ntz, `Altitude (m)` double, `Longitude (deg)` double, `Latitude (deg)` double, `Density (kg/m^3)` double, n long"
    sources = []
    for i in range(12):
        rows = [(stamp + dt.timedelta(hours=j), 400000.0, float(i), 2.0, 2.0, 100 * i + j) for j in range(3 + i)]
        sources.append(f"{tmp_path}/in/f{i}_merged.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(sources[-1])
    odd = f"{tmp_path}/in/odd_merged.parquet"
    spark.createDataFrame([(stamp, 1.0, 1.0, 1.0, 1.0)], schema.rsplit(",", 1)[0]).write.parquet(odd)
    os.makedirs(f"{tmp_path}/in/junk_merged.parquet")
    with open(f"{tmp_path}/in/junk_merged.parquet/a.parquet", "w") as out:
        out.write("no parquet")
    sources += [odd, f"{tmp_path}/in/junk_merged.parquet", f"{tmp_path}/in/gone_merged.parquet"]
    daily = spark.createDataFrame([(2003, 1, d, *[float(d)] * 8, 7.0, 90.0 + d, 111.0, "OBS") for d in (1, 2, 3)], SPACE_WEATHER)

    def model(times, lon, *rest, **more):
        if 5.0 in lon:
            raise ValueError("five")
        return closed_form(times, lon, *rest, **more)

    jobs = spark.sparkContext.statusTracker()
    group = "many"
    spark.sparkContext.setJobGroup(group, group)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    log = {r.source_file: r for r in generate.generate(spark, sources, model, daily, f"{tmp_path}/log").collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(jobs.getJobIdsForGroup(group)) < 45  # not one for each file
    bad = {sources[5]: "five", sources[13]: "Parquet", sources[14]: "gone"}
    for i, s in enumerate(sources):
        if s in bad:
            assert log[s].status == "failed" and bad[s] in log[s].error and not os.path.exists(generate.output_path(s))
        else:
            assert log[s].status == "success" and log[s].rows == (1 if s == odd else 3 + i) and log[s].elapsed_s >= 0
            made = spark.read.parquet(generate.output_path(s))
            assert made.count() == log[s].rows and not any(c.startswith("_") for c in made.columns) and made.where("`msis_density_2.0` is null").count() == 0
            assert s == odd or sorted(r.n for r in made.collect()) == [100 * i + j for j in range(3 + i)]
    assert sorted(n for n in os.listdir(tmp_path / "in") if n.startswith(".")) == []
    again = generate.generate(spark, sources, closed_form, daily, f"{tmp_path}/log")
    assert {r.status for r in again.collect() if r.source_file not in bad} == {"skipped"}
    assert [r.status for r in again.collect() if r.source_file == sources[5]] == ["success"]


def test_second_branch(spark, tmp_path):
    from orbiteer.plans import second

    rows = spark.createDataFrame([(dt.datetime(2003, 1, d, 1), 400000.0, 1.0, 2.0, 2.0, "X") for d in (1, 2, 3)], "timestamp timestamp_ntz, `Altitude (m)` double, `Longitude (deg)` double, `Latitude (deg)` double, `Density (kg/m^3)` double, mission string")
    rows.write.parquet(f"{tmp_path}/in")
    daily = spark.createDataFrame([(2003, 1, d, *[float(d)] * 8, 7.0, 90.0 + d, 0.0, "OBS") for d in (1, 2, 3)], SPACE_WEATHER)
    second.write_second(spark, f"{tmp_path}/in", f"{tmp_path}/out", daily, closed_form)
    made = spark.read.parquet(f"{tmp_path}/out")
    assert {"Altitude_m_", "Density_kg_m_3_", "matlab_density", "matlab_f107_daily", "matlab_f107_81day_avg"} <= set(made.columns) and "Altitude (m)" not in made.columns
    found = {r.timestamp.day: r for r in made.collect()}
    assert found[1].matlab_f107_daily is None and found[3].matlab_f107_daily == 92.0 and found[3].matlab_f107_81day_avg == 92.0
    assert found[3].matlab_density == pytest.approx(200 + 1 - 2 + 2 * 92 + 92 + 7)
    analysed = ratios.analysed(rows.withColumn("msis_density_0", F.lit(2.0)), made)
    assert "ln_density_ratio_matlab_density" in analysed.columns and analysed.count() == 3


def test_listings_and_months(spark):
    from orbiteer.plans import download

    assert download.months("2000-11", "2001-02") == [(2000, 11), (2000, 12), (2001, 1), (2001, 2)]
    assert sorted(r.name for r in download.names_of(spark, b" a.zip \r\n\nb.zip\n").collect()) == ["a.zip", "b.zip"]
    assert sorted(r.name for r in download.names_of(spark, b'<a href="c.zip"><a href="d/">').collect()) == ["c.zip"]
