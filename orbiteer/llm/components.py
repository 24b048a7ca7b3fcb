"""Connected components of an edge table, by contraction, without collecting edges or nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, component long): the smallest node that each node can reach.

    Each turn points every node to the first of itself and its neighbours, follows the pointers twice, merges what
    points to the same node and drops edges inside it.  First is by number in every other turn, which ends stars
    around their smallest node at once, and by a hash that changes with the turn in the others, which leaves about a
    third of the nodes even of a long path; so turns grow with the logarithm of the longest path.
    Loops give their node a row; rows with nulls are ignored; an empty table gives an empty result."""
    edges = written(edges.select("a", "b").where("a is not null and b is not null").distinct())
    found, old, turn = None, None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2 == 0:
            up = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        else:
            order = lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("p"))  # noqa: E731, B023
            up = both.groupBy("a").agg(F.least(order("a"), F.min(order("b"))).alias("x")).select("a", "x.p")
        near = written(up)
        up = near
        for _ in range(2):
            then = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = up.join(then, "p").select("a", F.col("q").alias("p"))
        up = written(up)
        if found is None:
            found = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            then = up.select(F.col("a").alias("component"), F.col("p").alias("q"))
            found = found.join(then, "component", "left").select("node", F.coalesce("q", "component").alias("component"))
        first = edges.join(up.withColumnRenamed("p", "x"), "a").select("x", "b")
        second = first.join(up.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        before = edges
        edges = written(second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        found = written(found)
        discard(before, near, up, *([old] if old is not None else []))
        old = found
        if edges.isEmpty():
            least: Column = F.min("node").alias("least")
            return found.join(found.groupBy("component").agg(least), "component").select("node", F.col("least").alias("component"))
        turn += 1
