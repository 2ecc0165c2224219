"""Walks of syntax trees given as rows: (path, node, parent, kind, start); parent is null at a root.

Links are followed by doubling: after k rounds every row has jumped 2^k steps, so the rounds are as
many as the logarithm of the depth, whatever the number of nodes.  A round is one equi-join on
(path, node) and is written, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import written

#: Rounds after which links are taken to run in a circle.
MOST_ROUNDS = 40


def _parents(nodes: DataFrame) -> DataFrame:
    """(path, node, to) of nodes whose parent is there."""
    return nodes.where("parent is not null").select("path", "node", F.col("parent").alias("to")).join(nodes.select("path", F.col("node").alias("to")), ["path", "to"], "left_semi")


def _hop(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (path, node, to, ...) with ``to`` replaced by where links lead from there; rows that end there are dropped."""
    step = links.select("path", F.col("node").alias("to"), F.col("to").alias("_far"))
    return rows.join(step, ["path", "to"]).withColumn("to", F.col("_far")).drop("_far")


def roots(nodes: DataFrame) -> DataFrame:
    """(path, root): the nodes of each file without a parent."""
    return nodes.where("parent is null").select("path", F.col("node").alias("root"))


def ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(path, node, ancestor, kind, distance): every node (of ``of``: path, node, if given) with itself (distance 0) and all nodes above it."""
    links = written(_parents(nodes), "links")
    found = (nodes if of is None else of).select("path", "node", F.col("node").alias("to"), F.lit(0).alias("distance"))
    for k in range(MOST_ROUNDS):
        if links.isEmpty():
            break
        # found has the distances below 2^k, links lead 2^k steps up
        found = written(found.unionByName(_hop(found, links).withColumn("distance", F.col("distance") + (1 << k))), "ancestors")
        links = written(_hop(links, links), "links")
    else:
        raise ValueError("parents run in a circle")
    return found.withColumnRenamed("to", "ancestor").join(nodes.select("path", F.col("node").alias("ancestor"), "kind"), ["path", "ancestor"]).select("path", "node", "ancestor", "kind", "distance")


def follow(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, node, last): where links (path, node, to), at most one a node, lead from each node in the end."""
    ends = nodes.select("path", "node").join(links, ["path", "node"], "left").select("path", "node", F.coalesce("to", "node").alias("to"))
    ends = written(ends, "ends")
    for _ in range(MOST_ROUNDS):
        further = written(_hop(ends.withColumn("was", F.col("to")), ends), "ends")
        if further.where("to <> was").isEmpty():
            return ends.withColumnRenamed("to", "last")
        ends = further.drop("was")
    raise ValueError("links run in a circle")


def outermost_same_kind(nodes: DataFrame) -> DataFrame:
    """(path, node, top): the last node of an unbroken run of one kind upwards."""
    above = nodes.select("path", F.col("node").alias("parent"), F.col("kind").alias("above"))
    links = nodes.join(above, ["path", "parent"]).where("kind = above").select("path", "node", F.col("parent").alias("to"))
    return follow(nodes, links).withColumnRenamed("last", "top")


def upper_qualifier(names: DataFrame) -> DataFrame:
    """(path, node, found): from a qualified name leftwards, the outermost one whose left part is no type; null if there is none.

    names: (path, node, left_node, left_kind), one row per qualified name; left_node is the left part where that is
    a qualified name itself, left_kind the kind of its symbol, null where it has none.
    """
    links = names.where("left_kind = 'NamedType' and left_node is not null").select("path", "node", F.col("left_node").alias("to"))
    ends = follow(names, links).join(names.select("path", F.col("node").alias("last"), "left_kind"), ["path", "last"])
    return ends.select("path", "node", F.when(F.col("left_kind") != "NamedType", F.col("last")).alias("found"))


def _above_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """(path, node, found, distance, start): each node of a kind with the nodes above it; only these are walked from."""
    wanted = nodes.where(F.col("kind") == kind).select("path", "node", "start")
    up = ancestors(nodes, wanted).where("distance > 0").join(wanted, ["path", "node"])
    return up.select("path", F.col("ancestor").alias("node"), F.col("node").alias("found"), "distance", "start")


def first_below(nodes: DataFrame, kind: str) -> DataFrame:
    """(path, node, found): breadth first, the nearest descendant of a kind, the earliest of one depth."""
    return _above_kind(nodes, kind).groupBy("path", "node").agg(F.min_by("found", F.struct("distance", "start", "found")).alias("found"))


def below(nodes: DataFrame, kind: str) -> DataFrame:
    """(path, node, found): all descendants of a kind."""
    return _above_kind(nodes, kind).select("path", "node", "found")


def declared_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(path, node, full_name): written names of a declaration and those around it, joined from the outside in.  names: (path, node, name)."""
    up = ancestors(nodes, names).join(names.select("path", F.col("node").alias("ancestor"), "name"), ["path", "ancestor"])
    parts = up.groupBy("path", "node").agg(F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False).alias("p"))
    return parts.select("path", "node", F.array_join(F.transform("p", lambda x: x["name"]), ".").alias("full_name"))
