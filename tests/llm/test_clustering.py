"""Clustering by metric trees against plain rounds over all vectors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbiteer.llm import clustering


def plain(rows, k, rounds):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of rows (vec_id, vector), in Python's integers."""
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [list(v) for _, v in hashed[:k]]
    far = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z, strict=True))
    assign = lambda: [min((far(v, z), c) for c, z in enumerate(centroids))[::-1] for _, v in rows]
    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (x, _) in zip(rows, own, strict=True) if x == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    sha = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids]
    return sorted(((i, c, d, sum(e for x, e in own if x == c), sum(e for _, e in own), sha[c]) for (i, _), (c, d) in zip(rows, own, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(parts)


@pytest.mark.parametrize("spread,width", [(400, 4), (3, 4), (40, 20)])
def test_same_as_plain_rounds(spark, spread, width):
    draw = random.Random(spread)
    centres = [[draw.randrange(-300, 300) for _ in range(width)] for _ in range(6)]
    rows = [(i, [x + draw.randrange(-spread, spread + 1) for x in draw.choice(centres)]) for i in range(400)]
    assert found(clustering.cluster(table(spark, rows), k=7, rounds=3, tree=100, leaf=4)) == plain(rows, 7, 3)


def test_ties_copies_and_few_rows(spark):
    same = [(i, [5, -5]) for i in range(300)]
    grid = [(1000 + 7 * x + y, [x, y]) for x in range(7) for y in range(7)]
    for rows, k in ((same, 3), (same + grid, 4), (grid, 16), (grid[:2], 5), (grid[:1], 1), ([(1, [0, 0]), (1, [0, 0]), (1, [9, 9]), (None, [3, 3])], 2)):
        assert found(clustering.cluster(table(spark, rows), k=k, rounds=3, tree=64, leaf=2)) == plain(rows, k, 3)


def test_odd_rows(spark):
    rows = [(None, [1, 1]), (2, None)]
    assert clustering.cluster(table(spark, rows)).collect() == [] and clustering.cluster(table(spark, rows).limit(0)).columns[0] == "vec_id"
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(table(spark, [(1, [2**40]), (2, [0])]), k=2).collect()
    clash = table(spark, [(1, [1]), (2, [4])]).withColumns({c: F.lit("x") for c in ("cluster", "distance", "tree", "hash", "n", "s0")})
    assert found(clustering.cluster(clash, k=1)) == plain([(1, [1]), (2, [4])], 1, 3)


def test_query_keeps_whole_finite_vectors(spark, tmp_path):
    good = [0.1 * i for i in range(64)]
    rows = [(1, good), (2, good[:63]), (3, good[:63] + [None]), (4, good[:63] + [float("nan")]), (5, good[:63] + [float("inf")]), (6, None), (7, []), (8, good + [1.0]), (9, [-x for x in good])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.vec_id for r in clustering.op11(spark, str(tmp_path)).collect()) == [1, 9]


def test_whole_balls_are_taken():
    """Far groups are assigned without a look at their vectors."""
    draw = np.random.default_rng(0)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    tree = clustering.MetricTree(np.concatenate([c + draw.integers(-9, 10, (500, 2)) for c in centres]), 8)
    whole, own, leaves = tree.descend(centres)
    assert len(leaves) <= 4 and set(own) == {0, 1, 2} and len(whole) < 30
    assert (tree.spans[whole, 1] - tree.spans[whole, 0]).sum() >= 1500 - 4 * 8
