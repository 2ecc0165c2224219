"""Connected components of an edge table, without any neighbour list in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each vertex hands its least neighbour to its larger ones (or, small, to its smaller ones and itself).

    The least neighbour is an aggregate (combined before the shuffle) joined back, so a
    vertex with very many neighbours needs no list of them.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each vertex of edges (a, b); root is the least vertex of its component, also for itself.

    Alternates large and small star steps until every edge points at a root.  Each round is
    written to the shared folder.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        edges = written(_star(_star(edges, True).distinct(), False).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
