"""MinHash near-duplicate detection by an inverted join of signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import checkpoint, short_batches, small, table, tidy
from .components import connected_components

#: Coordinates of a signature.
COORDINATES = 48
#: Coordinates that two signatures must share to be compared.  At a likeness of 0.8, fewer agree for 3 pairs in a million.
MATCHES = 25
#: Members of a group that one task compares with each other or with as many others.
BLOCK = 256

#: Sets of a posting list up to which one task counts its pairs' matches; a longer list is counted in blocks of
#: ``CODES`` sets.
LIST, CODES = 128, 2048

_FACTORS = np.random.default_rng(9).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = "doc_id long, hash long, n_shingles long, set long, signature array<int>, codes binary"


def shingle_sets(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of consecutive rows: the sorted distinct shingle hashes of each row joined together, and each row's
    first (one more entry at the end).  A row with fewer than ``length`` words has one shingle, all its words."""
    for _, _, data, offsets in wordhash.slices(texts):
        words, first = wordhash.words(data, offsets, lower=True)
        grams = wordhash.runs(words, length)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= length:
                sets.append(np.unique(grams[a : b - length + 1]))
            elif b > a:
                sets.append(wordhash.runs(words[a:b], b - a))
            else:
                sets.append(words[:0])
        yield np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _keys(all_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set, 0 for an empty one."""
    key = np.zeros(len(first) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        key[full] = np.add.reduceat(wordhash.mix(all_ + np.uint64(1)), first[:-1][full])
    return key.view(np.int64)


def _signatures(all_: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """The smallest hash of each row's set under each of ``coordinates`` hash functions, 0 for an empty set."""
    out = np.zeros((len(first) - 1, coordinates), dtype=np.int32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[:-1][full]
        for i in range(coordinates):
            out[full, i] = (np.minimum.reduceat(all_ * _FACTORS[i], at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sign(length: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for all_, first in shingle_sets(batch.column(1), length):
                n = len(first) - 1
                signatures = _signatures(all_, first, coordinates)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * coordinates), pa.array(signatures.reshape(-1)))
                codes = pa.array([row.tobytes() for row in signatures.astype(np.uint8)], pa.binary())
                columns = [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(np.diff(first)), pa.array(_keys(all_, first)), lists, codes]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "n_shingles", "set", "signature", "codes"])
                at += n

    return run


def _roots(length: int, percent: int, coordinates: int, matches: int):
    """Of one block, or of two: joins members whose sets are alike, and returns each member with its group's root, the
    member whose signature is near to the most others.  Members that share ``comp`` are joined already."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["set", "text"]).sort_values(["set", "text"], ignore_index=True)
        made = [(all_[a:b], k, s) for all_, first in shingle_sets(pa.array(block["text"], pa.string()), length) for a, b, k, s in zip(first[:-1], first[1:], _keys(all_, first), _signatures(all_, first, coordinates), strict=True)]
        # the first row of each set, of those whose text it is of
        own, first_of = block["set"].to_numpy(), {}
        for i, x in enumerate(made):
            if x[1] == own[i]:
                first_of.setdefault(x[1], i)
        use = list(first_of.values())
        if not use:
            return pd.DataFrame({"set": own[:0], "root": own[:0]})
        own, sets, signatures = own[use], [made[i][0] for i in use], np.array([made[i][2] for i in use])
        sizes = np.array([len(s) for s in sets])
        near = np.array([(signatures == one).sum(axis=1, dtype=np.int16) for one in signatures])
        group = np.unique(block["comp"].to_numpy()[use], return_inverse=True)[1]
        apart = np.triu(near >= matches, 1) & (group[:, None] != group[None, :])
        apart &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        x, y = np.nonzero(apart)
        for k in np.argsort(-near[x, y], kind="stable"):
            i, j = x[k], y[k]
            if group[i] != group[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    group[group == group[j]] = group[i]
        root: dict[int, int] = {}
        for i in np.argsort(-(near >= matches).sum(axis=1), kind="stable"):
            root.setdefault(group[i], i)
        return pd.DataFrame({"set": own, "root": own[[root[g] for g in group]]})

    return run


def _near_in_lists(coordinates: int, matches: int):
    """Of rows (set, token, codes) sorted by token: joins sets of a list that have ``matches`` equal codes, and returns
    (a, b) for each set that is joined to another, b being the same for all that are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def join(sets: np.ndarray, tokens: np.ndarray, codes: np.ndarray) -> None:
            for k in range(1, LIST):
                at = np.flatnonzero(tokens[k:] == tokens[:-k])
                if not len(at):
                    return
                at = at[(codes[at] == codes[at + k]).sum(axis=1) >= matches]
                for a, b in zip(sets[at].tolist(), sets[at + k].tolist(), strict=True):
                    if (x := root(a)) != (y := root(b)):
                        parent[max(x, y)] = min(x, y)

        held = None
        for batch in batches:
            own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, coordinates)
            held = own if held is None else tuple(map(np.concatenate, zip(held, own, strict=True)))
            if len(held[0]):
                cut = int(np.searchsorted(held[1], held[1][-1]))
                join(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None:
            join(*held)
        roots = {x: root(x) for x in list(parent)}
        rows = [(x, y) for x, y in roots.items() if x != y]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], names=["a", "b"])

    return run


def _near_codes(coordinates: int, matches: int):
    """Of two blocks of a long list (set, comp, inside, codes): edges (a, b) between the comps of sets that have
    ``matches`` equal codes, enough of them to join all that any pair joins.  Pairs that are both ``inside``, the list's
    largest comp, aren't looked at."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(block["codes"]), dtype=np.uint8).reshape(-1, coordinates)
        comp = block["comp"].to_numpy()
        group, edges = comp.copy(), []
        for i in np.flatnonzero(~block["inside"].to_numpy()):
            near = np.flatnonzero(((codes == codes[i]).sum(axis=1) >= matches) & (group != group[i]))
            for other in np.unique(group[near]):
                j = near[group[near] == other][0]
                edges.append((comp[i], comp[j]))
                group[group == other] = group[i]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _part(n: str, block: int):
    """A block number for each member of a group of ``n``, about ``block`` to a number."""
    return F.pmod(F.xxhash64("set"), F.ceil(F.col(n) / block))


def _pairs_of_blocks(own: DataFrame, by: str, block: int) -> DataFrame:
    """``own`` (set, comp, ``by`` and others), with a row for each pair of blocks (p) that a set is to be compared in.

    In a group by ``by``, all but its largest comp are outside.  A block of outsiders meets every block of the largest
    comp and every block of outsiders; groups of one comp have no row."""
    count = own.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("n"))
    count = count.groupBy(by).agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    count = checkpoint(count.select(by, F.col("top.comp").alias("main"), F.col("top.n").alias("in_main"), (F.col("n") - F.col("top.n")).alias("outside")))
    own = own.join(small(count), by).withColumn("inside", F.col("comp") == F.col("main"))
    main_blocks, other_blocks = F.ceil(F.col("in_main") / block), F.ceil(F.col("outside") / block)
    own = own.withColumn("at", F.when(F.col("inside"), _part("in_main", block)).otherwise(_part("outside", block)))
    outer, to_main, at = F.sequence(F.lit(0).cast("long"), other_blocks - 1), F.lit(True).alias("to_main"), F.col("at")
    with_outer = F.transform(outer, lambda i: F.struct(i.alias("i"), at.alias("j"), to_main))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), main_blocks - 1), lambda j: F.struct(at.alias("i"), j.alias("j"), to_main))
    among = F.transform(outer, lambda j: F.struct(F.least(at, j).alias("i"), F.greatest(at, j).alias("j"), F.lit(False).alias("to_main")))
    pairs = F.explode(F.when(F.col("inside"), with_outer).otherwise(F.concat(with_main, among))).alias("p")
    return own.select("*", pairs).drop("at", "main", "in_main", "outside")


def _joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (set, comp) after joining comps by ``edges`` (a, b)."""
    merged = connected_components(edges).select(F.col("node").alias("comp"), F.col("component").alias("to"))
    return checkpoint(comps.join(merged, "comp", "left").select("set", F.coalesce("to", "comp").alias("comp")))


def _candidates(posts: DataFrame, classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(set, comp) of all sets of ``posts`` (set, token) that are joined to another by pairs which share a token and
    ``matches`` coordinates.

    A task counts the matches of the pairs of each short list.  In a long one, each set is first counted against the list's
    head; what that joins, with all that short lists join, are comps.  A list of copies is then one comp and done.  In
    others, only sets outside the list's largest comp are counted against all of it, in blocks."""
    heads = posts.groupBy("token").agg(F.min("set").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = checkpoint(posts.join(heads, "token"))
    # a byte of each coordinate is enough to count matches: it adds some, and loses none
    short = lists.where(F.col("n") <= LIST).select("set", "token").join(classes.select("set", "codes"), "set")
    near = short.repartition("token").sortWithinPartitions("token").mapInArrow(tidy(_near_in_lists(coordinates, matches)), "a long, b long")
    long = lists.where(F.col("n") > LIST)
    if long.isEmpty():
        return checkpoint(connected_components(near).select(F.col("node").alias("set"), F.col("component").alias("comp")))
    long = checkpoint(long.select("set", "token", "head").join(classes.select("set", "signature", "codes"), "set"))
    head = checkpoint(long.where("set = head").select("token", F.col("signature").alias("of_head")))
    equal = F.aggregate(F.zip_with("signature", "of_head", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    stars = long.join(small(head), "token").where((F.col("set") != F.col("head")) & (equal >= matches)).select(F.col("set").alias("a"), F.col("head").alias("b"))
    comps = checkpoint(connected_components(stars.union(near)).select(F.col("node").alias("set"), F.col("component").alias("comp")))
    own = long.select("set", "token", "codes").join(comps, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    edges = _pairs_of_blocks(checkpoint(own), "token", CODES).groupBy("token", "p").applyInPandas(_near_codes(coordinates, matches), "a long, b long")
    edges = checkpoint(edges.distinct())
    alone = edges.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(comps, "set", "left_anti").select("set", F.col("set").alias("comp"))
    return comps if edges.isEmpty() else _joined(comps.union(alone), edges)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """As ``groups``, without what tells rows of one doc_id apart."""
    return groups(docs, shingle, percent, coordinates, matches, block).select("doc_id", "n_shingles", "component_id", "kept")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """Groups ``docs`` (doc_id, text): those whose sets of ``shingle``-word runs have 100 * intersection >=
    ``percent`` * union are linked.  Returns a row per input row: doc_id, hash (``F.xxhash64`` of the text),
    n_shingles, component_id, kept, chosen.  kept says whether doc_id is component_id, the smallest doc_id of the group;
    chosen, whether doc_id and hash are those of one text of the group, that of the smallest doc_id, then hash.

    Method: every distinct set is posted once under each (coordinate, value) of its MinHash signature.  Values that
    only one set has are skipped.  Of what is left, two signatures that share ``matches`` coordinates share one of
    each's rarest m - ``matches`` + 1 (m: its coordinates left), so only this prefix is merged.  A task counts the
    matches of the sets that share a list and joins those with enough; long lists are counted in blocks
    (``_candidates``).  What is joined is a group, compared in blocks of ``block`` by whole sets: first each
    block in itself, then the roots found, then the sets outside a group's largest component with all of the group, of
    both those whose rarest shingles leave a link possible (``_live``).  No pair of a group is dropped and none is sent out, only each member's root.

    ASCII letters are lower-cased; words are as in ``common.WORD``.  A null or empty text has no shingle and is linked
    with nothing: component_id is its own doc_id.  A row with a null doc_id is returned with a null component_id and
    kept.  Rows that repeat a doc_id count as documents of their own; equal texts are one set, and of equal doc_ids the
    smallest hash of the text is chosen.  A long text counts whole (about 20 bytes for each word of it are held).  An
    empty table gives no row.  Further columns are ignored, whatever their names."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    signed = checkpoint(docs.mapInArrow(tidy(_sign(shingle, coordinates)), _SETS))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set").agg(F.min(F.struct("doc_id", "hash", "signature", "codes")).alias("m"))
    classes = checkpoint(classes.select("set", "m.*"))

    tokens = classes.select("set", F.posexplode("signature").alias("i", "value"))
    tokens = tokens.select("set", F.expr("shiftleft(bigint(i), 32) | (bigint(value) & 4294967295)").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = tokens.join(shared, "token").groupBy("set").agg(F.collect_list(F.struct("n", "token")).alias("t")).where(F.size("t") >= matches)
    posts = left.select("set", F.explode(F.slice(F.array_sort("t"), F.lit(1), F.size("t") - (matches - 1))).alias("t")).select("set", "t.token")
    posts = checkpoint(posts)
    blobs = _candidates(posts, classes, coordinates, matches).withColumnRenamed("comp", "blob")

    sizes = checkpoint(blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("n")))
    members = checkpoint(blobs.join(small(sizes), "blob").join(classes, "set").select("doc_id", "hash", "set", "blob", "n"))
    roots, kind = _roots(shingle, percent, coordinates, matches), "set long, root long"
    first = docs.join(small(members), ["doc_id", "hash"]).withColumn("comp", F.col("set"))
    # as many tasks as the session has partitions: few bytes of text take long to compare
    first = first.withColumn("part", _part("n", block)).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "blob", "part")
    comps = first.groupBy("blob", "part").applyInPandas(roots, kind)
    comps = checkpoint(comps.select("set", F.col("root").alias("comp")))
    large = members.where(F.col("n") > block)
    if not large.isEmpty():
        comps = _across_blocks(docs, large, comps, roots, kind, block, shingle, percent)

    joined = classes.select("set", F.struct("doc_id", "hash").alias("least")).join(comps, "set")
    least = checkpoint(joined.groupBy("comp").agg(F.min("least").alias("least")))
    least = checkpoint(joined.drop("least").join(least, "comp").select("set", "least"))
    own = classes.select("set", F.struct("doc_id", "hash").alias("own"))
    label = checkpoint(own.join(least, "set", "left").select("set", F.coalesce("least", "own").alias("least")))
    found = signed.drop("signature", "codes").join(label, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    chosen = kept & F.coalesce(F.col("doc_id").isNull() | (F.col("hash") == F.col("least.hash")), F.lit(True))
    return found.select("doc_id", "hash", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen"))


def _shingles(length: int):
    """Of rows (set, blob, comp, text): a row for each shingle, with the number of all of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for all_, first in shingle_sets(batch.column(3), length):
                n, size = len(first) - 1, np.diff(first)
                key, sets = _keys(all_, first), batch.column(0).slice(at, n).to_numpy()
                whole = key == sets  # of rows that share doc_id and hash, those with this set's text
                size = np.where(whole, size, 0)
                token = all_[np.repeat(whole, np.diff(first))].view(np.int64)
                columns = [np.repeat(batch.column(i).slice(at, n).to_numpy(), size) for i in range(3)]
                columns += [np.repeat(size, size).astype(np.int64), token]
                for i in range(0, len(token), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["set", "blob", "comp", "size", "token"])
                at += n

    return run


def _live(docs: DataFrame, own: DataFrame, length: int, percent: int) -> DataFrame:
    """(set): the members of ``own`` (doc_id, hash, set, blob, comp) that may be linked to one of another comp of their blob.

    Two sets that are alike share one of each's rarest shingles, as many as are left when ``percent`` of the set, one
    less, are taken away.  Shingles are counted within blobs of several comps; those that only one set has can't be shared but
    take their places.  So of a template's many texts, each with more of its own than the likeness allows, none is left, and
    what is sent to be compared doesn't grow with the square of their number."""
    several = checkpoint(own.groupBy("blob").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("blob"))
    own = own.join(small(several), "blob").select("doc_id", "hash", "set", "blob", "comp")
    texts = docs.join(small(checkpoint(own)), ["doc_id", "hash"]).select("set", "blob", "comp", "text")
    tokens = texts.mapInArrow(tidy(_shingles(length)), "set long, blob long, comp long, size long, token long").distinct()
    tokens = checkpoint(tokens)
    shared = tokens.groupBy("blob", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sets = tokens.join(shared, ["blob", "token"]).groupBy("set", "blob", "comp", "size").agg(F.collect_list(F.struct("n", "token")).alias("t"))
    # of the prefix, what shingles of the set alone don't take
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("t"))
    rare = sets.where(prefix > 0).select("set", "blob", "comp", F.explode(F.slice(F.array_sort("t"), F.lit(1), prefix.cast("int"))).alias("t"))
    rare = checkpoint(rare.select("set", "blob", "comp", "t.token"))
    lists = rare.groupBy("blob", "token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("blob", "token")
    return checkpoint(rare.join(lists, ["blob", "token"], "left_semi").select("set").distinct())


def _across_blocks(docs: DataFrame, large: DataFrame, comps: DataFrame, roots, kind: str, block: int, length: int, percent: int) -> DataFrame:
    """``comps`` (set, comp) after comparing members of different blocks of the ``large`` groups."""
    tops = large.join(comps.select(F.col("comp").alias("set")).distinct(), "set").withColumn("comp", F.col("set")).drop("n")
    tops = checkpoint(tops.join(tops.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), "blob"))
    again = docs.join(small(tops), ["doc_id", "hash"]).groupBy("blob", _part("n", block).alias("part")).applyInPandas(roots, kind)
    again = again.select(F.col("set").alias("comp"), "root")
    comps = checkpoint(comps.join(again, "comp", "left").select("set", F.coalesce("root", "comp").alias("comp")))

    own = checkpoint(large.drop("n").join(comps, "set"))
    live = _live(docs, own, length, percent)
    if live.isEmpty():
        return comps
    pairs = _pairs_of_blocks(checkpoint(own.join(small(live), "set", "left_semi")), "blob", block).select("doc_id", "hash", "set", "blob", "comp", "p")
    links = docs.join(small(checkpoint(pairs)), ["doc_id", "hash"]).groupBy("blob", "p").applyInPandas(roots, kind)
    links = checkpoint(links.where("set <> root").distinct())
    first = comps.select("set", F.col("comp").alias("a"))
    second = comps.select(F.col("set").alias("root"), F.col("comp").alias("b"))
    return _joined(comps, links.join(first, "set").join(second, "root").where("a <> b").select("a", "b"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
