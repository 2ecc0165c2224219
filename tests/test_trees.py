import random

import pytest
from pyspark.sql import functions as F

from quern.operators import trees

SCHEMA = "path string, node int, parent int, kind string, start int"


def forest(seed, n=60):
    rng = random.Random(seed)
    return [(p, i, None if i == 0 or rng.random() < 0.05 else rng.randint(max(0, i - 4), i - 1), rng.choice("abc"), rng.randint(0, 30)) for p in ("f", "g") for i in range(n)]


def up(rows):
    parent = {(p, i): x for p, i, x, _, _ in rows}
    out = {}
    for p, i, *_ in rows:
        x, d = i, 0
        while x is not None and (p, x) in parent:
            out[p, i, x] = d
            x, d = parent[p, x], d + 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_walks_against_plain_ones(spark, seed):
    rows = forest(seed)
    nodes = spark.createDataFrame(rows, SCHEMA)
    kind = {(p, i): k for p, i, _, k, _ in rows}
    start = {(p, i): s for p, i, _, _, s in rows}
    parent = {(p, i): x for p, i, x, _, _ in rows}
    above = up(rows)
    assert {(r["path"], r["node"], r["ancestor"]): r["distance"] for r in trees.ancestors(nodes).collect()} == above
    tops = {}
    for p, i, _, k, _ in rows:
        x = i
        while parent[p, x] is not None and kind[p, parent[p, x]] == k:
            x = parent[p, x]
        tops[p, i] = x
    assert {(r["path"], r["node"]): r["top"] for r in trees.outermost_same_kind(nodes).collect()} == tops
    down = {(p, x, i): d for (p, i, x), d in above.items() if d and kind[p, i] == "b"}
    assert {(r["path"], r["node"], r["found"]) for r in trees.below(nodes, "b").collect()} == set(down)
    first = {}
    for (p, x, i), d in down.items():
        first[p, x] = min(first.get((p, x), (99, 0, 0)), (d, start[p, i], i))
    assert {(r["path"], r["node"]): r["found"] for r in trees.first_below(nodes, "b").collect()} == {k: v[2] for k, v in first.items()}
    assert {(r["path"], r["root"]) for r in trees.roots(nodes).collect()} == {(p, i) for (p, i), x in parent.items() if x is None}


def test_deep_and_many(spark):
    """A tree 1,000 deep, and 600,000 nodes in trees of four."""
    deep = spark.range(1000).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent"), F.when(F.col("id") == 999, "leaf").otherwise("a").alias("kind"), F.lit(0).alias("start"))
    assert trees.first_below(deep, "leaf").count() == 999
    assert trees.outermost_same_kind(deep).where("top = 0").count() == 999
    assert trees.ancestors(deep).agg(F.count("*"), F.max("distance")).first()[:] == (500_500, 999)
    many = spark.range(600_000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 4)).alias("path"), (F.col("id") % 4).cast("int").alias("node"), F.when(F.col("id") % 4 > 0, F.col("id") % 4 - 1).cast("int").alias("parent"), F.when(F.col("id") % 4 == 3, "leaf").otherwise("a").alias("kind"), F.lit(0).alias("start"))
    assert trees.below(many, "leaf").count() == 450_000
    assert trees.outermost_same_kind(many).where("top = 0").count() == 450_000


def test_a_circle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(trees, "MOST_ROUNDS", 4)
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([("f", 1, 2, "a", 0), ("f", 2, 1, "a", 0)], SCHEMA))


def test_upper_qualifier(spark):
    # N.Outer.Inner.X: node 3 is the whole; of lone types, of a name without symbol
    rows = [("f", 3, 2, "NamedType"), ("f", 2, 1, "NamedType"), ("f", 1, None, "Namespace"), ("f", 5, 4, "NamedType"), ("f", 4, None, "NamedType"), ("f", 7, 6, "NamedType"), ("f", 6, None, None), ("f", 8, 4, "Namespace")]
    got = trees.upper_qualifier(spark.createDataFrame(rows, "path string, node int, left_node int, left_kind string"))
    assert {r["node"]: r["found"] for r in got.collect()} == {3: 1, 2: 1, 1: 1, 5: None, 4: None, 7: None, 6: None, 8: 8}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trees.ancestors(none).count() == trees.first_below(none, "a").count() == trees.outermost_same_kind(none).count() == 0
