"""Who owns a file, and which namespace its project gives it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import default_fallback, without_framework
from quern.functions.paths import ancestors, folder_of, is_build_output, path_key
from quern.operators.ordered import first_wins


def file_projects(solution_file: DataFrame) -> DataFrame:
    """(path_key, path, project_name, project_file, project_ord, ord): the first project of a file wins; build output is left out."""
    live = solution_file.where(F.col("path").isNotNull() & (F.col("path") != "") & ~is_build_output(F.col("path"), folder_of(F.col("project_file"))))
    keyed = live.withColumn("path_key", path_key(F.col("path"))).withColumn("project_name", without_framework(F.col("project_name")))
    return first_wins(keyed, ["path_key"], ["priority", "project_ord", "project_file"]).select("path_key", "path", "project_name", "project_file", "project_ord", "ord")


def deepest_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_file): the project whose folder lies deepest above the file.

    A prefix join, written as an equi-join: a file is exploded into its ancestor folders (as
    many as its path is deep), which meet project folders by key.
    """
    p = projects.select(path_key(folder_of(F.col("project_file"))).alias("folder"), "project_file", "project_ord")
    up = files.select("path", F.explode(ancestors(folder_of(F.col("path")))).alias("folder"))
    return first_wins(up.join(p, "folder"), ["path"], [(-F.length("folder")).alias("depth"), "project_ord", "project_file"]).select("path", "project_file")


def default_namespaces(projects: DataFrame, default_ns: DataFrame) -> DataFrame:
    """(project_file, project_name, default_ns): the first non-empty one stated, else the fallback from the name."""
    stated = default_ns.where(F.coalesce("default_ns", F.lit("")) != "").groupBy("project_file").agg(F.min_by("default_ns", "ord").alias("stated"))
    return projects.select("project_file", "project_name").distinct().join(stated, "project_file", "left").select("project_file", "project_name", F.coalesce("stated", default_fallback(F.col("project_name"))).alias("default_ns"))


def in_scope(document: DataFrame) -> DataFrame:
    return document.where((F.col("language") == "C#") & F.col("supports_compilation") & F.col("path").isNotNull())


def shared_files(document: DataFrame) -> DataFrame:
    """path_key of files that several project files compile; the frameworks of one project count once."""
    d = document.where("path is not null").select(path_key(F.col("path")).alias("path_key"), F.upper(F.coalesce("project_file", "project_name")).alias("p"))
    return d.groupBy("path_key").agg(F.min("p").alias("a"), F.max("p").alias("z")).where("a <> z").select("path_key")


def below_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that equal a root or lie below one; without roots, all files."""
    if roots.isEmpty():
        return files
    keys = roots.select(F.rtrim(path_key(F.col("root")), F.lit("\\")).alias("k")).distinct()
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("k")).join(keys, "k", "left_semi").select("path").distinct()
    return files.join(up, "path", "left_semi")


def unmatched_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots that no file equals or lies below."""
    up = files.select(F.explode(ancestors(F.col("path"))).alias("k")).distinct()
    return roots.withColumn("k", F.rtrim(path_key(F.col("root")), F.lit("\\"))).join(up, "k", "left_anti").select("root")
