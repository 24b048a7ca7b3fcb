"""Hosts, paths and rules by hand-written cases; the template tree by tables whose templates are known, and by its SQL in test_sql."""

import pytest
from pyspark.sql import functions as F

from orbiteer.llm import url_filters


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("HTTP://A.Net/En/?q=1#f", "a.net", "/En/", "net/", "block"),
    ("https://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/en", "example.net", "/en", "net/", "block"),
    ("https://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("https://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("https://x.example.com/en/1", "x.example.com", "/en/1", None, "allow"),
    ("https://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("https://org/fr/x", "org", "/fr/x", "org/fr/", "allow"),
    ("https://aorg/fr/x", "aorg", "/fr/x", None, "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x/y", "a.net", "", None, "allow"),
    ("http://ÄA.net#/x", "Äa.net", "", None, "allow"),
    ("s://a.net/p://b.org/fr/", "a.net", "/p://b.org/fr/", "net/", "block"),
    ("no scheme a.net/x", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    (":///net/", "", "/net/", None, "allow"),
    ("x\n://a.net/\nb", "a.net", "/\nb", "net/", "block"),
    ("https://a.net:80/x", "a.net:80", "/x", None, "allow"),
]


def test_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages(spark, [c[0] for c in CASES])).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]


def test_shapes(spark):
    paths = ["/a/12/b3.html", "", "/", "//x//", "/a/b/c/d/e/5", "/a/b/c/d"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(url_filters.shape(F.col("path"))).collect()] == [["a", "#", "b#.html"], [], [], ["x"], ["a", "b", "c", "d/e/#"], ["a", "b", "c", "d"]]


def judged(spark, rows):
    """{(host, path): row} of (url, label or None)."""
    labels = spark.createDataFrame([(i, l) for i, (_, l) in enumerate(rows) if l], "page_id long, label string")
    return {r.host + r.path: r for r in url_filters.judge(pages(spark, [u for u, _ in rows]), rules=(), labels=labels).collect()}


def test_pure_templates_are_rejected(spark):
    rows = [(f"http://h/promo/{i}", "block" if i < 10 else None) for i in range(20)] + [(f"http://h/news/{i}", "allow" if i < 10 else None) for i in range(20)]
    rows += [(f"http://h/mixed/{i}", "block" if i < 10 else "allow") for i in range(13)] + [("http://h/mixed/99", None), ("http://h/", None)]
    rows += [(f"http://other/promo/{i}", None) for i in range(5)]
    got = judged(spark, rows)
    assert got["h/promo/15"].verdict == "block" and (got["h/promo/15"].n_labelled, got["h/promo/15"].n_blocked) == (10, 10)
    assert got["h/news/15"].verdict == "allow" and got["h/mixed/99"].verdict == "allow" and got["h/"].template is None
    assert got["other/promo/1"].verdict == "allow" and got["other/promo/1"].n_labelled == 0  # a tree for each host


def test_variable_segments_become_one_branch(spark):
    slugs = ["".join(chr(97 + int(x)) for x in str(10_000 + i)) for i in range(100)]
    rows = [(f"http://h/u/{s}/spam", "block" if i < 50 else None) for i, s in enumerate(slugs)]
    got = judged(spark, rows)
    assert {r.template for r in got.values()} == {"/u/*/spam"} and {r.verdict for r in got.values()} == {"block"}


def test_alike_branches_share_their_labels(spark):
    """Two labelled pages aren't enough by themselves; branches with equal shares stand by each other."""
    rows = [(f"http://h/{name}/{i}", "block" if i < 2 else None) for name in ("aa", "bb", "cc") for i in range(4)]
    rows += [(f"http://h/{name}/{i}", "allow") for name in ("dd", "ee") for i in range(40)]
    got = judged(spark, rows)
    assert {r.template for p, r in got.items() if p[2:4] in ("aa", "bb", "cc")} == {"/aa|bb|cc/#"}
    assert {r.verdict for p, r in got.items() if p[2:4] in ("aa", "bb", "cc")} == {"block"}
    assert {r.template for p, r in got.items() if p[2:4] in ("dd", "ee")} == {"/dd|ee/#"}


def test_odd_rows(spark):
    df = pages(spark, ["http://a.net/x"] * 4 + [None] * 3 + ["http://h/" + "long/" * 20_000, "http://h/" + "é" * 100_000])
    df = df.withColumn("page_id", F.when(F.col("page_id") > 1, F.col("page_id"))).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "template", "shape", "label", "block", "node")})
    labels = spark.createDataFrame([(None, "block"), (5, None), (5, "odd"), (0, "block"), (0, "allow")], "page_id long, label string")
    for given in (None, labels, labels.limit(0)):
        got = url_filters.judge(df, labels=given)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "n_labelled", "n_blocked"]
        assert sorted(r.verdict for r in got.collect()) == ["allow"] * 5 + ["block"] * 4
    assert url_filters.judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("one,other,alike", [((10, 0, 0), (0, 0, 50), False), ((5, 5, 0), (6, 4, 0), True), ((0, 0, 9), (0, 0, 1), True), ((1, 0, 0), (0, 1, 0), True), ((9, 0, 0), (0, 9, 0), False)])
def test_alike(spark, one, other, alike):
    df = spark.createDataFrame([(one, other)], "x struct<block:long,allow:long,none:long>, y struct<block:long,allow:long,none:long>")
    assert df.select(url_filters._alike(F.col("x"), F.col("y"))).first()[0] == alike
