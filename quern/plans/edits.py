"""Edits as rows, and their application to bodies.

All edits of a file become replacements of disjoint spans of its text as it was: renames of
declarations, rewritten references, new and deleted imports.  One ordered pass over a file's
text applies them, so positions never shift and nothing is parsed again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import normal_using
from quern.operators.ordered import apply_spans, greedy_spans


def edit_set(edits: DataFrame) -> DataFrame:
    """Equal edits once, numbered in order of insertion (``at``) within their file."""
    keys = ["path", "kind", "span_start", "span_len", "text"]
    return edits.groupBy(*keys).agg(F.min("at").alias("at"))


def new_usings(edits: DataFrame, using: DataFrame) -> DataFrame:
    """(path, ns) to be imported: not what a clause of the file itself imports already (aliases and statics do not count)."""
    have = using.where("alias is null and not is_static and not in_namespace").select("path", normal_using(F.col("name")).alias("text")).distinct()
    return edits.where("kind = 'add_using'").groupBy("path", "text").agg(F.min("at").alias("at")).join(have, ["path", "text"], "left_anti")


def using_spans(wanted: DataFrame, using: DataFrame, bodies: DataFrame) -> DataFrame:
    """One insertion per file: after its last own clause, indented like it, else before everything but the header comment; lines end in CRLF."""
    last = using.where("not in_namespace").groupBy("path").agg(F.max_by(F.struct("start", "len"), "start").alias("u"))
    lines = wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("w"))
    j = lines.join(bodies.select("path", "body"), "path").join(last, "path", "left")
    before = F.substring(F.col("body"), F.lit(1), F.col("u.start"))
    indent = F.when(F.col("u").isNotNull(), F.regexp_extract(before, r"([ \t]*)$", 1)).otherwise(F.lit(""))
    header = F.length(F.regexp_extract("body", r"(?s)^((?:\s*(?://[^\n]*(?:\n|$)|/\*.*?\*/\s*))*)", 1))
    clause = F.array_join(F.transform("w", lambda x: F.concat(indent, F.lit("using "), x["text"], F.lit(";"))), "\r\n")
    return j.select("path", F.when(F.col("u").isNotNull(), F.col("u.start") + F.col("u.len")).otherwise(header).alias("start"), F.lit(0).alias("len"), F.when(F.col("u").isNotNull(), F.concat(F.lit("\r\n"), clause)).otherwise(F.concat(clause, F.lit("\r\n"))).alias("text"))


def rename_spans(decls: DataFrame, transitions: DataFrame) -> DataFrame:
    """Name spans of the declarations whose full name a root transition moves; each span once, however many compilations have it."""
    d = decls.select("path", F.array_join("parts", ".").alias("original"), "name_start", "name_len").distinct()
    return d.join(transitions.where("is_root").select("path", "original", "modified"), ["path", "original"]).select("path", F.col("name_start").alias("start"), F.col("name_len").alias("len"), F.col("modified").alias("text"))


def apply(bodies: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, encoding, body) of the files that change: overlapping spans give way to the first and longest."""
    per_file = spans.groupBy("path").agg(F.collect_set(F.struct("start", "len", "text")).alias("spans"))
    return bodies.join(per_file, "path").withColumn("new", apply_spans(F.col("body"), greedy_spans(F.col("spans")))).where("new <> body").select("path", "encoding", F.col("new").alias("body"))
