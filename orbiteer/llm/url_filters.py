"""URL filters: rules of hosts and paths, and for the rest a tree of path templates for each host, with DataFrame
functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fits, small, table

#: (verdict, host and path): a rule is for its host and all subdomains, and for paths that begin as its path does.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of a template; segments below are one level, the last.
DEPTH = 4
#: A segment stays literal if it is on as many pages and on one in WIDE of its branch; a node has at most WIDE of those.
LEAST, WIDE = 3, 32
#: Branches are alike if the chi-square of their counts isn't above this, by degrees of freedom (95 %).
ALIKE = (0.0, 3.841459, 5.991465)
#: A template is rejected if the share of blocked pages among its labelled ones, with one page more of either kind, is as high.
#: It is judged from as many labelled pages on, else the template above it is.
PURITY, LABELLED = 0.8, 3

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ("block", "allow", "none")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first "://", up to "/", "?", "#" or the end, in small letters of A to Z; and from there up to "?", "#"
    or the end.  Both are empty without "://" and for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda i: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), _CAPITALS, _SMALL), part(2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does.  Of equally long ones the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, begin = text.partition("/")
        fits_ = ((host == own) | host.endswith("." + own)) & path.startswith(slash + begin)
        rule, verdict = F.when(fits_, text).otherwise(rule), F.when(fits_, kind).otherwise(verdict)
    return rule, verdict


def shape(path: Column, depth: int = DEPTH) -> Column:
    """The segments of a path, each run of digits as one "#"; empty ones go, and those below ``depth`` are joined to one."""
    parts = F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), "")
    below = F.array_join(F.slice(parts, depth, 2**31 - 1), "/")
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(below))).otherwise(parts)


def _alike(x: Column, y: Column) -> Column:
    """Whether two branches' counts of blocked, allowed and unlabelled pages may be of one kind: a test of homogeneity."""
    pages = lambda b: b["block"] + b["allow"] + b["none"]
    n, m = pages(x).cast("double"), pages(y).cast("double")
    chi, kinds = F.lit(0.0), F.lit(-1)
    for k in _COUNTS:
        both = (x[k] + y[k]).cast("double")
        off = x[k].cast("double") - n * both / (n + m)
        chi = chi + F.when(both > 0, off * off * (n + m) * (n + m) / (n * m * both)).otherwise(0.0)
        kinds = kinds + F.when(both > 0, 1).otherwise(0)
    return chi <= F.get(F.array(*map(F.lit, ALIKE)), F.greatest(kinds, F.lit(0)))


def merged(branches: Column) -> Column:
    """Groups of the branches of one node, an array of (names, block, allow, none), of which each takes in the next branch, by
    rising share of blocked and then of allowed pages, as long as that is like it."""
    one = lambda b: F.struct(F.array(b["name"]).alias("names"), *[b[k].alias(k) for k in _COUNTS])
    both = lambda g, b: F.struct(F.concat(g["names"], F.array(b["name"])).alias("names"), *[(g[k] + b[k]).alias(k) for k in _COUNTS])
    empty = F.array().cast("array<struct<names:array<string>,block:bigint,allow:bigint,none:bigint>>")

    def step(groups: Column, b: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(both(last, b)))
        return F.when((F.size(groups) > 0) & _alike(last, b), grown).otherwise(F.concat(groups, F.array(one(b))))

    return F.aggregate(F.array_sort(branches), empty, step)


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, template, block, allow) of ``pages`` (host, shape, label): for each shape its template, deepest first
    of those judged by enough labels, and the labelled pages there; nulls if there are none.

    The tree grows a level at a time, from the root, over different shapes, not pages: pages are counted by host and shape
    where they are read before anything is shuffled.  At each node a segment that is on few of its pages is variable and
    becomes "*"; so at most ``WIDE`` + 1 branches are left, and those that are alike become one, whose pages share what is below."""
    counts = [F.count_if(F.col("label") == k).alias(k) for k in _COUNTS[:2]] + [F.count_if(F.col("label").isNull()).alias("none")]
    shapes = checkpoint(pages.where(F.size("shape") > 0).groupBy("host", "shape").agg(*counts))
    state = shapes.select("host", "shape", *_COUNTS, F.lit("").alias("node"), F.lit(None).cast("struct<template:string,block:bigint,allow:bigint>").alias("best"))
    levels = shapes.agg(F.max(F.size("shape")).alias("n")).first()["n"] or 0
    n = sum((F.col(k) for k in _COUNTS), F.lit(0))
    for level in range(min(levels, depth)):
        segment = F.get("shape", F.lit(level))
        here = state.withColumn("segment", segment)
        children = here.where("segment is not null").groupBy("host", "node", "segment").agg(*[F.sum(k).alias(k) for k in _COUNTS])
        totals = children.groupBy("host", "node").agg(F.sum(n).alias("pages"))
        literal = (n >= LEAST) & (n * WIDE >= F.col("pages"))
        named = children.join(totals, ["host", "node"]).withColumn("name", F.when(literal, F.col("segment")).otherwise("*"))
        branches = named.groupBy("host", "node", "name").agg(*[F.sum(k).alias(k) for k in _COUNTS])
        # shares first, to sort by them
        branch = F.struct((F.col("block") / n).alias("blocked"), (F.col("allow") / n).alias("allowed"), "name", *_COUNTS)
        groups = branches.groupBy("host", "node").agg(F.collect_list(branch).alias("branches")).select("host", "node", F.explode(merged(F.col("branches"))).alias("g"))
        title = F.array_join(F.array_sort("g.names"), "|")
        groups = groups.select("host", "node", F.explode("g.names").alias("name"), title.alias("title"), *[F.col(f"g.{k}").alias(f"g_{k}") for k in _COUNTS])
        groups = named.select("host", "node", "segment", "name").join(groups, ["host", "node", "name"]).drop("name")
        groups = checkpoint(groups)
        size = F.length("host") + F.length("node") + F.length("segment") + F.length("title") + 64
        groups = F.broadcast(groups) if fits(groups, size) else groups
        down = here.join(groups, ["host", "node", "segment"], "left")
        path = F.concat("node", F.lit("/"), "title")
        judged = F.col("g_block") + F.col("g_allow") >= LABELLED
        best = F.when(judged, F.struct(path.alias("template"), F.col("g_block").alias("block"), F.col("g_allow").alias("allow"))).otherwise(F.col("best"))
        state = checkpoint(down.select("host", "shape", *_COUNTS, F.coalesce(path, "node").alias("node"), best.alias("best")))
    return state.select("host", "shape", "best.template", "best.block", "best.allow")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """Rows of ``pages`` (page_id, url): page_id, host, path, rule (the longest that fits, or null), verdict (that rule's, else
    the templates'), template (of the host's tree, by which it was judged), n_labelled and n_blocked of its pages there.

    A page without a rule is blocked if the template is pure: (n_blocked + 1) / (n_labelled + 2) is ``PURITY`` or more;
    else, and without a template that has enough labelled pages, it is allowed.  Labels are what the rules say of the pages
    they fit or, if given, those of ``labels`` (page_id, label: block or allow; of a page_id that repeats the smallest label).

    Each row is judged by itself: a page_id may be null or repeat, with the same or another url, and rows that repeat count
    as often as they are there.  A null url, or one without "://", has an empty host and path and is allowed, as is a path
    without segments.  Urls of any length are read whole.  Ties can't occur: branches with equal shares are taken by
    name.  An empty table gives no row.  Further columns are ignored, whatever their names."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict, "shape": shape(F.col("path"), depth)})
    if labels is None:
        labelled = rows.withColumn("label", F.col("_verdict"))
    else:
        known = labels.where("page_id is not null and label in ('block', 'allow')").groupBy("page_id").agg(F.min("label").alias("label"))
        labelled = rows.join(known, "page_id", "left")
    tree = templates(labelled.select("host", "shape", "label"), depth).where("template is not null")
    found = rows.join(small(checkpoint(tree), 100_000), ["host", "shape"], "left")
    pure = (F.col("block") + 1) / (F.col("block") + F.col("allow") + 2) >= PURITY
    said = F.coalesce("_verdict", F.when(pure, "block"), F.lit("allow")).alias("verdict")
    n = F.coalesce(F.col("block") + F.col("allow"), F.lit(0).cast("long")).alias("n_labelled")
    return found.select("page_id", "host", "path", "rule", said, "template", n, F.coalesce("block", F.lit(0).cast("long")).alias("n_blocked"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same tree, level by level; branches of a node are taken in one after the other by recursion."""
    chi = " + ".join(
        f"""CASE WHEN f.{k} + b.{k} > 0 THEN (f.{k}::DOUBLE - f.n * (f.{k} + b.{k})::DOUBLE / (f.n + b.n)) * (f.{k}::DOUBLE - f.n * (f.{k} + b.{k})::DOUBLE / (f.n + b.n))
 * (f.n + b.n) * (f.n + b.n) / (f.n * b.n * (f.{k} + b.{k})::DOUBLE) ELSE 0 END"""
        for k in _COUNTS
    )
    kinds = " + ".join(f"(f.{k} + b.{k} > 0)::INTEGER" for k in _COUNTS)
    alike = f"({chi}) <= [{', '.join(map(str, ALIKE))}][greatest({kinds}, 1)]"
    sums = ", ".join(f"sum({k})::BIGINT AS {k}" for k in _COUNTS)
    n = " + ".join(_COUNTS)
    cases = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r if what else kind}'"
        for kind, r in sorted(RULES, key=lambda x: -len(x[1]))
    ) + " END"
    parts = [
        "rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)",
        f"""cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_CAPITALS}', '{_SMALL}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)""",
        f"ruled AS (SELECT *, {cases(True)} AS rule, {cases(False)} AS said, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS parts FROM cut)",
        f"""paged AS (SELECT page_id, host, path, rule, said, CASE WHEN len(parts) > {DEPTH} THEN list_concat(parts[1:{DEPTH - 1}], [array_to_string(parts[{DEPTH}:], '/')]) ELSE parts END AS shape FROM ruled)""",
        """s0 AS (SELECT host, shape, count(*) FILTER (WHERE said = 'block') AS block, count(*) FILTER (WHERE said = 'allow') AS allow, count(*) FILTER (WHERE said IS NULL) AS none,
 '' AS node, NULL::VARCHAR AS template, NULL::BIGINT AS b, NULL::BIGINT AS a FROM paged WHERE len(shape) > 0 GROUP BY host, shape)""",
    ]
    for i in range(DEPTH):
        parts += [
            f"c{i} AS (SELECT host, node, shape[{i + 1}] AS segment, {sums} FROM s{i} WHERE len(shape) > {i} GROUP BY ALL)",
            f"w{i} AS (SELECT *, CASE WHEN {n} >= {LEAST} AND ({n}) * {WIDE} >= sum({n}) OVER (PARTITION BY host, node) THEN segment ELSE '*' END AS name FROM c{i})",
            f"b{i} AS (SELECT *, ({n})::DOUBLE AS n, row_number() OVER (PARTITION BY host, node ORDER BY block / ({n})::DOUBLE, allow / ({n})::DOUBLE, name) AS r FROM (SELECT host, node, name, {sums} FROM w{i} GROUP BY ALL))",
            f"""f{i} AS (SELECT host, node, r, r AS g, {", ".join(_COUNTS)}, n FROM b{i} WHERE r = 1 UNION ALL
 SELECT b.host, b.node, b.r, CASE WHEN {alike} THEN f.g ELSE b.r END, {", ".join(f"CASE WHEN {alike} THEN f.{k} ELSE 0 END + b.{k}" for k in (*_COUNTS, "n"))}
 FROM f{i} f JOIN b{i} b ON b.host = f.host AND b.node = f.node AND b.r = f.r + 1)""",
            f"""t{i} AS (SELECT host, node, g, array_to_string(list_sort(list(name)), '|') AS title, {sums} FROM f{i} JOIN (SELECT host, node, r, name, block AS block_, allow AS allow_ FROM b{i}) USING (host, node, r) GROUP BY host, node, g)""",
            f"""s{i + 1} AS (SELECT s.host, s.shape, s.block, s.allow, s.none, CASE WHEN t.title IS NULL THEN s.node ELSE s.node || '/' || t.title END AS node,
 CASE WHEN t.b + t.a >= {LABELLED} THEN s.node || '/' || t.title ELSE s.template END AS template, CASE WHEN t.b + t.a >= {LABELLED} THEN t.b ELSE s.b END AS b, CASE WHEN t.b + t.a >= {LABELLED} THEN t.a ELSE s.a END AS a
 FROM s{i} s LEFT JOIN w{i} w ON w.host = s.host AND w.node = s.node AND w.segment = s.shape[{i + 1}]
 LEFT JOIN b{i} n ON n.host = w.host AND n.node = w.node AND n.name = w.name LEFT JOIN f{i} f ON f.host = n.host AND f.node = n.node AND f.r = n.r
 LEFT JOIN (SELECT t.host, t.node, t.g, t.title, l.block AS b, l.allow AS a FROM t{i} t JOIN (SELECT host, node, g, max_by(block, r) AS block, max_by(allow, r) AS allow FROM f{i} GROUP BY ALL) l USING (host, node, g)) t
 ON t.host = f.host AND t.node = f.node AND t.g = f.g)""",
        ]
    return f"""WITH RECURSIVE {", ".join(parts)}
SELECT page_id, p.host, p.path, p.rule, coalesce(p.said, CASE WHEN (b + 1) / (b + a + 2)::DOUBLE >= {PURITY}::DOUBLE THEN 'block' END, 'allow') AS verdict, template,
 coalesce(b + a, 0)::BIGINT AS n_labelled, coalesce(b, 0)::BIGINT AS n_blocked
FROM paged p LEFT JOIN s{DEPTH} s ON s.host = p.host AND s.shape = p.shape"""


OP13_SQL = _sql()
