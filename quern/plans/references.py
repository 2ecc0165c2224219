"""Edits of references to moved types, from facts about names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import first_part, is_shadowed, nested_in
from quern.operators.ordered import first_wins

#: Members whose accesses only need the namespace imported.
MEMBERS = ("Property", "Field", "Method")


def needs_global(refs: DataFrame, visible: DataFrame) -> DataFrame:
    """refs with ``global_needed``: the target's first part would bind to something else than that root namespace."""
    seen = visible.where(~(F.col("is_namespace") & (F.col("full_name") == F.col("name")))).select("path", F.col("start"), F.col("name").alias("part")).distinct().withColumn("global_needed", F.lit(True))
    return refs.withColumn("part", first_part(F.col("target_ns"))).join(seen, ["path", "start", "part"], "left").withColumn("global_needed", F.coalesce("global_needed", F.lit(False))).drop("part")


def locate(refs: DataFrame, moved: DataFrame) -> DataFrame:
    """Reference locations of moved types, each location of a type once; what is in the target already is left out."""
    j = refs.join(moved.select("type_full", "class_name", "target_ns").distinct(), "type_full").where(F.coalesce("symbol_ns", F.lit("")) != F.col("target_ns"))
    return first_wins(j, ["type_full", "target_ns", "path", "start", "len"], ["text"])


def reference_edits(refs: DataFrame, visible: DataFrame, moved: DataFrame) -> DataFrame:
    """(path, kind, span_start, span_len, text): add_using of the target, or replace_text.

    The ladder: documentation references, qualified names, member accesses, everything else.  A qualified name
    whose left part is a namespace gets a new left part; a member access is rewritten from the type on,
    unless importing is enough; a plain name is imported, or qualified where the target's own name shadows it.
    """
    r = needs_global(locate(refs, moved), visible)
    prefix = F.when(F.col("is_global") | F.col("global_needed"), F.lit("global::")).otherwise(F.lit(""))
    target = F.concat(prefix, F.col("target_ns"))
    shadowed = is_shadowed(F.col("target_ns"), F.col("class_name"), F.col("scope_ns"))
    kind, member = F.col("parent_kind"), F.col("symbol_kind").isin(*MEMBERS)
    replace_outer = F.concat(target, F.lit("."), F.col("tail"))
    text: Column = (
        F.when(kind == "cref", F.when(F.col("container_is_namespace"), target))
        .when(kind == "qualified", F.when(F.col("container_is_namespace"), replace_outer).when((F.col("chain_pos") == 0) & shadowed, replace_outer))
        .when(kind == "member", F.when(~member & (F.col("chain_pos") >= 0) & ((F.col("chain_pos") > 0) | shadowed), replace_outer))
        .when(shadowed & (F.col("text") == F.col("class_name")), F.concat(target, F.lit("."), F.col("text")))
    )
    r = r.withColumn("new", text)
    outer = F.col("parent_kind").isin("cref", "qualified", "member")
    return r.select(
        "path", F.when(F.col("new").isNull(), "add_using").otherwise("replace_text").alias("kind"),
        F.when(F.col("new").isNotNull(), F.when(outer, F.col("outer_start")).otherwise(F.col("start"))).alias("span_start"),
        F.when(F.col("new").isNotNull(), F.when(outer, F.col("outer_len")).otherwise(F.col("len"))).alias("span_len"),
        F.coalesce("new", "target_ns").alias("text"), F.col("start").alias("at"),
    ).distinct()


def self_reference_edits(refs: DataFrame, decls: DataFrame) -> DataFrame:
    """add_using for names that were found through the old enclosing namespace and will not be through the new one.

    refs: (path, start, symbol_ns, decl_original, decl_modified) of names inside moved declarations.
    """
    lost = nested_in(F.col("original"), F.col("symbol_ns")) & ~nested_in(F.col("modified"), F.col("symbol_ns"))
    j = refs.join(decls.select("path", F.col("original"), F.col("modified"), F.col("original").alias("scope_ns")), ["path", "scope_ns"])
    return j.where(lost & (F.coalesce("symbol_ns", F.lit("")) != "")).select("path", F.lit("add_using").alias("kind"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_len"), F.col("symbol_ns").alias("text"), F.col("start").alias("at")).distinct()
