"""A solution of any size as facts, derived from the driver's tables: one file an order.

The relations are stated once, in SQL that Spark and DuckDB both read, so that both sides of a
comparison start from the same rows.  Remainders of the keys decide what a file is: stray, linked from
outside, compiled by two projects or for two frameworks, at home already, or of a type name
that its target has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.model import SCHEMAS, Facts
from quern.sample import duck_type

_P = "o_custkey % 40"
_FOLDERS = "concat('F', o_orderkey % 11, CASE WHEN o_orderkey % 3 = 0 THEN concat('{dot}G', o_orderkey % 5) ELSE '' END)"
_FILE = f"""(SELECT o_orderkey AS o, {_P} AS p,
  CASE WHEN o_orderkey % 103 = 0 THEN concat('c:/linked/C', o_orderkey, '.cs') ELSE concat('c:/s/P', {_P}, '/', {_FOLDERS.format(dot='/')}, '/C', o_orderkey, CASE WHEN o_orderkey % 109 = 0 THEN '.xaml' ELSE '.cs' END) END AS path,
  concat('c:/s/P', {_P}, '/P', {_P}, '.csproj') AS project_file, concat('P', {_P}, '.Core') AS project_name,
  CASE WHEN o_orderkey % 5 < 2 THEN concat('Root', {_P}, '.', {_FOLDERS.format(dot='.')}) ELSE concat('Old.N', o_orderkey % 300) END AS ns, concat('T', o_orderkey % 37) AS type_name
  FROM {{orders}})"""
#: Compilations of a file: a second one for every fourth project, and for files that a second project compiles.
_COMPILED = f"""(SELECT f.*, concat('p', p, '-a') AS project_id, project_file AS owner, 0 AS nth FROM {_FILE} f UNION ALL
  SELECT f.*, concat('p', p, '-b') AS project_id, project_file AS owner, 1 AS nth FROM {_FILE} f WHERE p % 4 = 0 UNION ALL
  SELECT f.*, 'other' AS project_id, 'c:/s/Other/Other.csproj' AS owner, 2 AS nth FROM {_FILE} f WHERE o % 107 = 0)"""

RELATIONS = {
    "solution_file": f"""SELECT path, project_name, project_file, 0 AS priority, p AS project_ord, o AS ord FROM {_FILE} f WHERE o % 101 <> 0 UNION ALL
      SELECT path, 'Other', 'c:/s/Other/Other.csproj', 1, 99, o FROM {_FILE} f WHERE o % 107 = 0""",
    "document": f"SELECT path, project_id, project_name, owner AS project_file, CASE WHEN o % 113 = 0 THEN 'Text' ELSE 'C#' END AS language, true AS supports_compilation FROM {_COMPILED} c WHERE o % 109 <> 0",
    "default_ns": f"SELECT DISTINCT project_file, CASE WHEN p % 5 <> 0 THEN concat('Root', p) END AS default_ns, 1 AS ord FROM {_FILE} f",
    "namespace_decl": f"SELECT path, project_id, 1 AS decl_id, ns AS parts, o % 2 = 0 AS file_scoped, 10 AS name_start, length(ns) AS name_len, 1 AS ord FROM {_COMPILED} c WHERE o % 109 <> 0",
    "type_decl_part": f"SELECT path, project_id, ns, type_name, concat(ns, '.', type_name) AS full_name, NULL AS containing_type, 'class' AS kind, 1 AS decl_id, o % 211 = 0 AS from_metadata, 1 AS ord FROM {_COMPILED} c WHERE o % 109 <> 0 AND (nth = 0 OR o % 7 <> 0)",
    "using_clause": f"SELECT f.path, concat(CASE WHEN l_linenumber = 2 THEN 'global:: ' ELSE '' END, 'Old.N', l_partkey % 300) AS name, CASE WHEN l_partkey % 17 = 0 THEN 'Alias' END AS alias, false AS is_static, l_linenumber = 3 AS in_namespace, l_linenumber * 20 AS start, 14 AS len FROM {{lineitem}} l JOIN {_FILE} f ON f.o = l.l_orderkey",
    "candidate": f"SELECT o AS seq, path FROM {_FILE} f",
}


@dataclass(frozen=True)
class Solution:
    """The solution that the tables of a folder give."""

    folder: str


def facts(spark: SparkSession, folder: str) -> Facts:
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("orders", "lineitem")}

    def relation(name: str) -> DataFrame:
        df = spark.sql(RELATIONS[name], **{k: v for k, v in tables.items() if "{" + k + "}" in RELATIONS[name]})
        types = [c.split() for c in SCHEMAS[name].split(", ")]
        return df.select(*(F.array(c).alias(c) if t.startswith("ARRAY") else F.col(c).cast(t).alias(c) for c, t in types))

    return Facts(spark, {name: relation(name) for name in RELATIONS})


def relation(name: str) -> str:
    """The same rows as a DuckDB relation; relations that are not generated are empty."""
    types = [c.split() for c in SCHEMAS[name].split(", ")]
    if name not in RELATIONS:
        return "(SELECT " + ", ".join(f"NULL::{duck_type(t)} AS {c}" for c, t in types) + " WHERE false)"
    columns = ", ".join(f"[{c}] AS {c}" if t.startswith("ARRAY") else f"{c}::{duck_type(t)} AS {c}" for c, t in types)
    return f"(SELECT {columns} FROM ({RELATIONS[name].format(orders='orders', lineitem='lineitem')}) AS given)"
