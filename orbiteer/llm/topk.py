"""Exact top-k search by inner product: branch and bound over a ball tree for each shard of the candidates."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, short_batches, table, tidy

#: Candidates in a shard, of which one task makes a tree; queries that go down a tree together; vectors in a leaf.
SHARD, QUERIES, LEAF = 8192, 4096, 64
#: Bytes of the queries, as they are stored, of a cell of the grid (a component is one to eight of them), and trees there.
QUERY_BYTES, CELL_TREES = 4 << 20, 8

#: Stand for an empty place among a query's best.  The first can be negated.
NO_SCORE, NO_ID = -(2**63) + 1, 2**63 - 1

_SHARDS = "shard int, n int, tree binary, queries binary, found binary"
_FOUND = "shard int, place int, query_id long, vec_id long, score long"


class BallTree:
    """Balls (centre, radius) around halves of halves of integer vectors, split where they spread most, down to leaves."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._split(0, len(vectors), leaf)
        self.vectors = vectors[self.order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _split(self, a: int, b: int, leaf: int) -> int:
        own = self.vectors[self.order[a:b]].astype(np.float64)
        centre = own.mean(axis=0)
        node = len(self.spans)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.spans.append((a, b))
        self.children.append(None)
        if b - a > leaf:
            # two far points, and the line between them
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            along = own @ (other - far)
            self.order[a:b] = self.order[a:b][np.argsort(along, kind="stable")]
            middle = (a + b) // 2
            self.children[node] = (self._split(a, middle, leaf), self._split(middle, b, leaf))
        return node

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The most that a query's inner product with a vector of a node can be; half more, for rounding."""
        return queries @ self.centres[nodes].T + norms[:, None] * self.radii[nodes] + 0.5


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: in doubles where those hold every sum, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products of these vectors exceed 64 bits")
    return a @ b.T


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, best_score: np.ndarray, best_id: np.ndarray) -> None:
    """Merges the vectors of a tree into each query's best so far, ``best_score`` and ``best_id`` (queries, k), in place:
    those that score ``floor`` or more, ties to smaller ids.  ``ids`` are the vectors' in the tree's order, ``own`` the
    place there that a query leaves out, or -1.

    All queries go down the tree together: a node is opened for those whose bound there is not below their kth score so
    far, leaves by falling bound, and each leaf lifts it."""
    k = best_score.shape[1]
    if not k:
        return
    real = queries.astype(np.float64)
    norms = np.sqrt((real**2).sum(axis=1))
    kth = np.maximum(floor, best_score[:, -1]).astype(np.float64)
    pairs, nodes = [], {0: np.arange(len(queries))}
    while nodes:
        below: dict[int, np.ndarray] = {}
        for node, who in nodes.items():
            bound = tree.bounds(real[who], norms[who], np.array([node]))[:, 0]
            live = bound >= kth[who]
            if tree.children[node] is None:
                pairs.append((who[live], np.full(int(live.sum()), node), bound[live]))
            elif live.any():
                below.update(dict.fromkeys(tree.children[node], who[live]))
        nodes = below
    if not pairs:
        return
    who, leaf, bound = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((-bound, who))
    who, leaf, bound = who[order], leaf[order], bound[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    done, step = 0, 1
    while done <= rank.max(initial=-1):
        now = np.flatnonzero((rank >= done) & (rank < done + step) & (bound >= kth[who]))
        now = now[np.argsort(leaf[now], kind="stable")]
        edges = np.flatnonzero(np.r_[True, leaf[now][1:] != leaf[now][:-1], True]) if len(now) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            a, b = tree.spans[leaf[now[i]]]
            q = who[now[i:j]]
            score = _exact(queries[q], tree.vectors[a:b])
            skip = (own[q][:, None] == np.arange(a, b)) | (score < floor[q][:, None])
            score = np.where(skip, NO_SCORE, score)
            id_ = np.where(skip, NO_ID, ids[a:b])
            better = np.flatnonzero((score >= best_score[q][:, -1:]).any(axis=1))
            if len(better):
                both_s, both_i = np.hstack([best_score[q[better]], score[better]]), np.hstack([best_id[q[better]], id_[better]])
                top = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                best_score[q[better]], best_id[q[better]] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_i, top, 1)
        kth = np.maximum(kth, best_score[:, -1].astype(np.float64))
        done, step = done + step, step * 2


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Integer rows; a shorter vector is filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = vectors.min(initial=0), vectors.max(initial=0)
    return vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(vectors: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    out[:, : vectors.shape[1]] = vectors
    return out


def _rows(shard: np.ndarray, place: np.ndarray, query: np.ndarray, best_score: np.ndarray, best_id: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What was found, a row for each; a query is told by its shard and place there."""
    q, r = np.nonzero(best_id != NO_ID)
    for i in range(0, len(q), 50_000):
        at, n = q[i : i + 50_000], r[i : i + 50_000]
        columns = [pa.array(shard[at], pa.int32()), pa.array(place[at], pa.int32()), pa.array(query[at], pa.int64()), pa.array(best_id[at, n], pa.int64()), pa.array(best_score[at, n], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def _none(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((queries, k), NO_SCORE), np.full((queries, k), NO_ID)


def _shards(k: int, leaf: int, most: int):
    """Of all rows (vec_id, vector, is_query) of a task: a tree for each ``most`` of them, and their queries after these have
    searched it, with what they found; trees, queries and findings are pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 12
        held = None

        def shard(rows: pa.Table, number: int) -> pa.RecordBatch:
            ids, vectors = rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks())
            tree = BallTree(vectors, leaf)
            ids = ids[tree.order]
            own = np.flatnonzero(rows.column(2).to_numpy(zero_copy_only=False)[tree.order])
            queries, (score, found) = tree.vectors[own], _none(len(own), k)
            for i in range(0, len(own), QUERIES):
                part = slice(i, i + QUERIES)
                search(tree, ids, queries[part], own[part], np.full(len(own[part]), NO_SCORE), score[part], found[part])
            floor = score[:, -1] if k else np.zeros(len(own))
            tree.vectors, tree.order = _narrow(tree.vectors), None
            pickled = [pickle.dumps(x, 5) for x in ((tree, ids), (number, own, ids[own], _narrow(queries), floor), (score, found))]
            columns = [pa.array([number], pa.int32()), pa.array([len(own)], pa.int32()), *(pa.array([x], pa.binary()) for x in pickled)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            while len(held) >= 2 * most:
                yield shard(held.slice(0, most), first)
                held, first = held.slice(most), first + 1
        if held is not None and len(held):
            yield shard(held, first)

    return run


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for queries, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            number, own, ids, _, _ = pickle.loads(queries)
            yield from _rows(np.full(len(own), number), own, ids, *pickle.loads(found))


def _away(k: int):
    """Of rows (c, r, shard, tree, queries) by cell (c, r), in each the queries of some shards before the trees of others:
    what those queries find in all of these trees that aren't their own.  The best so far go from tree to tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                number, place, query, _, _, score, found = state
                yield from _rows(number, place, query, score, found)

        for batch in batches:
            for i in range(len(batch)):
                at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if at != cell:
                    yield from done()
                    cell, known, state = at, [], None
                if batch.column(4)[i].is_valid:
                    known.append(pickle.loads(batch.column(4)[i].as_py()))
                    continue
                if not known:
                    continue
                if state is None:
                    number = np.concatenate([np.full(len(x[1]), x[0]) for x in known])
                    place, query, floor = (np.concatenate([x[c] for x in known]) for c in (1, 2, 4))
                    width = max(x[3].shape[1] for x in known)
                    state = number, place, query, floor, np.concatenate([_wide(x[3], width) for x in known]), *_none(len(query), k)
                number, _, _, floor, vectors, score, found = state
                tree, ids = pickle.loads(batch.column(3)[i].as_py())
                both = max(vectors.shape[1], tree.vectors.shape[1])
                tree.vectors = _wide(tree.vectors, both)
                tree.centres = np.pad(tree.centres, ((0, 0), (0, both - tree.centres.shape[1])))
                others = np.flatnonzero(number != batch.column(2)[i].as_py())
                for a in range(0, len(others), QUERIES):
                    part = others[a : a + QUERIES]
                    s, f = score[part], found[part]
                    search(tree, ids, _wide(vectors[part], both), np.full(len(part), -1), floor[part], s, f)
                    score[part], found[part] = s, f
        yield from done()

    return run


def _grid(trees: DataFrame, query_bytes: int, cell_trees: int) -> DataFrame:
    """(c, r, shard, tree, queries): the cells of a grid whose columns are groups of shards' queries and whose rows are groups of
    trees, each tree in all columns of its row and each shard's queries in all rows of its column.

    Shards are numbered by the partitions that they were dealt to evenly, one to each (two if it is uneven), so as many
    successive ones as fit in ``query_bytes`` by the size of the largest are a column."""
    part = F.shiftright("shard", 12)
    known = trees.agg(F.coalesce(F.max(F.length("queries")), F.lit(1)).alias("most"), F.coalesce(F.max(part), F.lit(0)).alias("last")).first()
    wide = max(1, query_bytes // known["most"])
    columns = known["last"] // wide + 1
    column = F.floor(part / wide).cast("int")
    rows = max(1, -(-trees.count() // cell_trees))
    row = F.pmod(F.xxhash64("shard", F.lit(1)), F.lit(rows)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = trees.select(each(columns).alias("c"), row.alias("r"), "shard", "tree", F.lit(None).cast("binary").alias("queries"))
    queries = trees.where("n > 0").select(column.alias("c"), each(rows).alias("r"), "shard", F.lit(None).cast("binary").alias("tree"), "queries")
    cells = queries.union(candidates).repartition(max(1, min(columns * rows, 10_000)), "c", "r")
    return cells.sortWithinPartitions("c", "r", F.col("queries").isNull())


def top_k(vectors: DataFrame, is_query, k: int = 20, shard: int = SHARD, leaf: int = LEAF, query_bytes: int = QUERY_BYTES, cell_trees: int = CELL_TREES) -> DataFrame:
    """For each row of ``vectors`` (vec_id long, vector array<long>) where ``is_query`` holds: its ``k`` largest inner
    products with other rows, as query_id, rank, vec_id, score; ties to the smaller vec_id; all, if there are fewer.

    Rows are dealt evenly to shards of about ``shard`` rows, whatever is in them, which is the one shuffle of vectors.  The
    task of a shard makes its tree, once, and its own queries search it; the kth score that they find there is where they
    start everywhere else.  Then one job takes the queries to the trees: both are dealt to the cells of a grid, of at most
    ``query_bytes`` of queries and about ``cell_trees`` trees.  A cell reads its queries and takes its trees one after the other, so the
    kth score rises from tree to tree.  The number of jobs is the same for any number of queries; each tree is sent
    once for each group of queries.

    Rows with a null vec_id or vector take no part.  Rows that repeat a vec_id are rows of their own: each is a candidate of
    all others, and each a query, with results of its own.  An empty table gives no row.  Vectors of different lengths
    are filled up with zeros; a vector is held whole.  Products beyond 64 bits raise an error.  Further columns are
    ignored, whatever their names."""
    rows = vectors.where("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    n = rows.count()
    trees = rows.repartition(max(1, -(-n // shard))).mapInArrow(tidy(_shards(k, leaf, shard)), _SHARDS)
    trees = checkpoint(trees)
    found = trees.select("queries", "found").mapInArrow(tidy(_at_home), _FOUND)
    short_batches(vectors.sparkSession)
    more = _grid(trees, query_bytes, cell_trees).mapInArrow(tidy(_away(k)), _FOUND)
    found = found.union(more)
    order = Window.partitionBy("shard", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(``scale`` * x) of each component of ``embeddings`` (vec_id, embedding); no row for a vector that
    is null or holds a null, NaN or infinite component.  An empty vector stays."""
    infinite = float("inf")
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return embeddings.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.n AS q, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
