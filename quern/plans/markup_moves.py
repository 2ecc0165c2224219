"""Moves of types through markup documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import markup
from quern.functions.paths import path_key
from quern.operators.ordered import first_wins


def affected(fragments: DataFrame, moved: DataFrame) -> DataFrame:
    """(path, source_ns, class_name, target_ns): which documents refer to which moved types.

    An equi-join on (namespace, name): a fragment's alias leads to its first mapping; a markup
    extension also answers to its name with ``Extension``.
    """
    maps = first_wins(fragments.where("kind = 'mapping'"), ["path", "alias"], ["start"]).select("path", "alias", F.col("ns").alias("map_ns"))
    uses = fragments.where("kind in ('tag', 'extension', 'usage')").join(maps, ["path", "alias"]).select("path", F.col("map_ns").alias("source_ns"), "name", "is_markup_ext")
    named = uses.select("path", "source_ns", F.col("name").alias("class_name")).unionByName(uses.where("is_markup_ext").select("path", "source_ns", F.concat("name", F.lit("Extension")).alias("class_name")))
    named = named.unionByName(fragments.where("kind = 'class'").select("path", F.col("ns").alias("source_ns"), F.col("name").alias("class_name")))
    return named.distinct().join(moved.select("source_ns", "class_name", "target_ns").distinct(), ["source_ns", "class_name"])


def move(bodies: DataFrame, moved: DataFrame, fragments: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(path, encoding, body) of the documents that change.  Only documents that refer to a moved type, or whose root class moves, are touched.

    roots: (path, target_ns) of the documents whose root class goes to a namespace of its own.  It goes there after
    the moved types, from where these left it, so the order of the files does not matter.
    """
    hits = affected(markup.scan(bodies) if fragments is None else fragments, moved)
    todo = hits.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("source_ns", "class_name", "target_ns"))).alias("moves"))
    work = bodies.join(todo, "path", "left").withColumn("k", path_key(F.col("path")))
    if roots is None:
        work = work.withColumn("root_ns", F.lit(None).cast("string"))
    else:
        work = work.join(roots.select(path_key(F.col("path")).alias("k"), F.col("target_ns").alias("root_ns")).dropDuplicates(["k"]), "k", "left")
    work = work.where("moves is not null or root_ns is not null").select("path", "encoding", "body", "moves", "root_ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, encoding, body, moves, root_ns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = body
                for m in moves or ():
                    new = markup.of_file(path, markup.move_class, new, m["source_ns"], m["class_name"], m["target_ns"], path)
                if new and root_ns is not None:
                    new = markup.of_file(path, markup.move_root, new, root_ns, path)
                if new != body:
                    rows.append((path, encoding, new))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "encoding", "body"])

    return work.mapInArrow(run, "path string, encoding string, body string")
