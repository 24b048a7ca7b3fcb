"""Centroid clustering of integer vectors: each round goes down metric trees, and whole balls go to one centroid."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy, written
from .topk import BallTree, _matrix, _narrow, quantised

#: Centroids, rounds and components; vectors of a tree and of a leaf.
CENTROIDS, ROUNDS, WIDTH, TREE, LEAF = 16, 3, 64, 8192, 32

_TREES, _SUMS = "tree binary", "cluster int, n long, squares long, sums array<long>"


class MetricTree:
    """A ball tree of integer vectors whose nodes have radius, count, integer sum and the sum of squared lengths, so a ball
    that goes to a centroid as a whole is counted without its vectors."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        tree = BallTree(vectors, leaf)
        self.order, self.vectors = tree.order, _narrow(tree.vectors)
        self.centres, self.radii, self.spans = tree.centres, tree.radii, np.array(tree.spans)
        self.children = np.array([x or (-1, -1) for x in tree.children])
        ahead = np.zeros((len(vectors) + 1, vectors.shape[1] + 1), dtype=np.int64)
        np.cumsum(np.column_stack([tree.vectors, (tree.vectors**2).sum(axis=1)]), axis=0, out=ahead[1:])
        inside = ahead[self.spans[:, 1]] - ahead[self.spans[:, 0]]
        self.sums, self.squares = inside[:, :-1], inside[:, -1]

    def descend(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that are nearest to one centroid as a whole, those centroids, and the leaves where that isn't known.

        With the nearest centroid at d from a ball's centre and the next at e, no vector within the radius r is as near to
        the next if e - r > d + r.  Both sides are of doubles; the slack is a million times their error."""
        away = np.stack([np.sqrt(((self.centres - z) ** 2).sum(axis=1)) for z in centroids.astype(np.float64)], axis=1)
        nearest = away.argmin(axis=1)
        first = away[np.arange(len(away)), nearest]
        away[np.arange(len(away)), nearest] = np.inf
        second = away.min(axis=1)
        sure = second - self.radii > first + self.radii + 1e-9 * (1 + first + self.radii + np.where(np.isfinite(second), second, 0))
        whole, leaves, front = [], [], np.zeros(1, dtype=np.int64)
        while len(front):
            whole.append(front[sure[front]])
            rest = front[~sure[front]]
            ends = self.children[rest, 0] < 0
            leaves.append(rest[ends])
            front = self.children[rest[~ends]].ravel()
        whole, leaves = np.concatenate(whole), np.concatenate(leaves)
        return whole, nearest[whole], leaves

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the vectors of ``nodes``, node by node."""
        n = self.spans[nodes, 1] - self.spans[nodes, 0]
        return np.arange(n.sum()) + np.repeat(self.spans[nodes, 0] - np.cumsum(n) + n, n)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, by doubles where those hold every sum."""
    a, b = vectors.astype(np.int64), centroids.astype(np.int64)
    most = 4.0 * a.shape[1] * max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))) ** 2
    if most >= 2**63:
        raise ValueError("squared distances of these vectors exceed 64 bits")
    inner = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T
    return (a**2).sum(axis=1)[:, None] - 2 * inner + (b**2).sum(axis=1)


def _trees(most: int, leaf: int) -> Callable:
    """Of a task's rows (vec_id, vector): a tree and its ids for each ``most`` of them, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(rows: pa.Table) -> pa.RecordBatch:
            made = MetricTree(_matrix(rows.column(1).combine_chunks()), leaf)
            ids = rows.column(0).combine_chunks().take(pa.array(made.order))
            made.order = None
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((made, ids), 5)], pa.binary())], names=["tree"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            while len(held) >= 2 * most:
                yield tree(held.slice(0, most))
                held = held.slice(most)
        if held is not None and len(held):
            yield tree(held)

    return run


def _unpickled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[MetricTree, pa.Array]]:
    for batch in batches:
        for x in batch.column(0):
            yield pickle.loads(x.as_py())


def _sums(centroids: np.ndarray) -> Callable:
    """Count, sum and squares of what is nearest to each centroid, added up over a task's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        n, squares, sums = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for tree, _ in _unpickled(batches):
            whole, cluster, leaves = tree.descend(centroids)
            np.add.at(n, cluster, tree.spans[whole, 1] - tree.spans[whole, 0])
            np.add.at(squares, cluster, tree.squares[whole])
            np.add.at(sums, cluster, tree.sums[whole])
            vectors = tree.vectors[tree.rows(leaves)].astype(np.int64)
            own = distances(vectors, centroids).argmin(axis=1)
            for i in np.unique(own):
                mine = vectors[own == i]
                n[i] += len(mine)
                squares[i] += (mine**2).sum()
                sums[i] += mine.sum(axis=0)
        used = np.flatnonzero(n)
        columns = [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(squares[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "squares", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids in _unpickled(batches):
            whole, cluster, leaves = tree.descend(centroids)
            own, far = np.empty(len(ids), dtype=np.int32), np.empty(len(ids), dtype=np.int64)
            own[tree.rows(whole)] = np.repeat(cluster, tree.spans[whole, 1] - tree.spans[whole, 0])
            at = tree.rows(leaves)
            near = distances(tree.vectors[at], centroids)
            own[at] = near.argmin(axis=1)
            for i in np.unique(own):
                mine = own == i
                far[mine] = distances(tree.vectors[mine], centroids[i : i + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def _totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """(n, squares, sums) of the vectors nearest to each centroid: a row for each centroid and task is shuffled, one for each
    centroid comes to the driver."""
    parts = trees.mapInArrow(tidy(_sums(centroids)), _SUMS)
    columns = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), *columns).collect()
    return {r[0]: (r[1], r[2], list(r[3:])) for r in rows}


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> list[list[int]]:
    """The vectors of the ``k`` smallest SHA-256 of "seed:vec_id"; of equal ones the smaller vectors first."""
    hashed = vectors.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [r["vector"] for r in hashed.orderBy("hash", "vector").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """For each row of ``vectors`` (vec_id long, vector array<long>, all of one length): vec_id, cluster, its squared distance
    from there, cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256 (of the
    final centroid's components in decimal, joined by commas).

    The first centroids are told by a hash of vec_id (``first_centroids``).  Each of ``rounds`` rounds assigns all vectors to
    their nearest centroid, ties to the smaller number, and moves each centroid to the floor of its vectors' mean; one without
    vectors stays.  Arithmetic is of integers throughout, so results don't depend on partitions.

    Tasks make trees of the rows they read, ``tree`` at a time, once: no vector is shuffled.  The trees are a table in the
    shared folder, which stays; a lost task reads its part again.  A round sends the centroids to the tasks and gets counts
    and sums of each centroid back.  The inertia too comes from sums: of n vectors with sum s and squares q, the squared
    distances from z add up to q - 2 s z + n z z.

    Rows with a null vector take no part; a null vec_id is assigned like others but is no first centroid (if no row has a
    vec_id, nothing is returned).  Rows that repeat a vec_id are rows of their own.  With fewer rows than ``k`` there are as
    many centroids as rows; equal centroids are all there, and the smallest number gets the vectors.  An empty table gives no
    row.  Distances beyond 64 bits raise an error.  Further columns are ignored, whatever their names."""
    vectors = vectors.where("vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    start = first_centroids(vectors, k)
    if not start:
        types = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    trees = written(vectors.mapInArrow(tidy(_trees(tree, leaf)), _TREES))
    centroids = np.array(start, dtype=np.int64)
    for _ in range(rounds):
        for i, (n, _, sums) in _totals(trees, centroids).items():
            centroids[i] = [s // n for s in sums]
    inertia = {}
    for i, (n, squares, sums) in _totals(trees, centroids).items():
        z = [int(x) for x in centroids[i]]
        inertia[i] = squares - 2 * sum(s * x for s, x in zip(sums, z, strict=True)) + n * sum(x * x for x in z)
    names = {i: hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest() for i in inertia}
    known = lambda d, kind: F.get(F.array(*[F.lit(d.get(i)).cast(kind) for i in range(len(centroids))]), F.col("cluster"))
    ends = {"cluster_inertia": known(inertia, T.LongType()), "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": known(names, T.StringType())}
    return trees.mapInArrow(tidy(_assigned(centroids)), "vec_id long, cluster int, distance long").withColumns(ends)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").where(F.size("embedding") == WIDTH))
    return cluster(vectors)


def _sql() -> str:
    """All distances of all rounds; components are whole doubles, whose sums are exact."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""z0 AS (SELECT c, z FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS z FROM v WHERE vec_id IS NOT NULL) WHERE c < {CENTROIDS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS (SELECT n, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, z) + list_inner_product(z, z), 'c': c}}) AS best FROM v, z{i} GROUP BY n)""")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT c, list(floor(s / k) ORDER BY i) AS z FROM (SELECT c, i, sum(x) AS s, count(*) AS k FROM (
 SELECT a.best.c AS c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{i} a JOIN v USING (n)) GROUP BY c, i) GROUP BY c),
z{i + 1} AS (SELECT z.c, coalesce(m.z, z.z) AS z FROM z{i} z LEFT JOIN m{i} m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.best.c::INTEGER AS cluster, a.best.d::BIGINT AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
 sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(z, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (n) JOIN z{ROUNDS} z ON z.c = a.best.c"""


OP11_SQL = _sql()
