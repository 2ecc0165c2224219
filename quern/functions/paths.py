"""Path expressions.  Paths are Windows paths; they compare by ``path_key``, never as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of generated files and names of build folders.
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs")
BUILD_FOLDERS = ("bin", "obj")


def path_key(path: Column) -> Column:
    return F.upper(F.replace(path, F.lit("/"), F.lit("\\")))


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1)


def folder_of(path: Column) -> Column:
    """Without a trailing separator; empty for a bare name."""
    p = F.replace(path, F.lit("/"), F.lit("\\"))
    return F.substring(p, F.lit(1), F.greatest(F.length(p) - F.length(F.substring_index(p, "\\", -1)) - 1, F.lit(0)))


def is_xaml(path: Column) -> Column:
    return F.lower(path).rlike(r"\.a?xaml$")


def is_generated(path: Column) -> Column:
    key = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    hit = key.contains("\\obj\\")
    for s in GENERATED_SUFFIXES:
        hit = hit | key.endswith(s)
    return F.coalesce(hit, F.lit(False))


def same_or_below(path: Column, root: Column) -> Column:
    """Up to a folder border: ``MyApp.Tests`` is not below ``MyApp``."""
    r = F.rtrim(path_key(root), F.lit("\\"))
    return (path_key(path) == r) | path_key(path).startswith(F.concat(r, F.lit("\\")))


def relative_to(path: Column, root: Column) -> Column:
    """The rest of the path below root, '' for root itself, null elsewhere."""
    p, r = F.replace(path, F.lit("/"), F.lit("\\")), F.rtrim(F.replace(root, F.lit("/"), F.lit("\\")), F.lit("\\"))
    return F.when(path_key(p) == path_key(r), F.lit("")).when(same_or_below(p, r), F.substring(p, F.length(r) + 2, F.length(p)))


def is_build_output(path: Column, project_folder: Column) -> Column:
    """In a bin or obj folder below the project's folder; folders above it do not count."""
    inside = F.split(relative_to(path, project_folder), r"\\")
    return F.coalesce(F.exists(inside, lambda x: F.lower(x).isin(*BUILD_FOLDERS)), F.lit(False))


def ancestors(folder: Column) -> Column:
    """Keys of a folder and of all folders above it, the shortest first: turns a prefix join into an equi-join."""
    parts = F.split(path_key(folder), r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))


def folder_chain(path: Column, project_file: Column, skipped: tuple[str, ...] = ()) -> Column:
    """Names of the folders from the project down to the file, without skipped ones (their subfolders stay).

    [] in the project's own folder, null outside it.
    """
    root = folder_of(project_file)
    inside = relative_to(folder_of(path), root)
    names = F.split(inside, r"\\")
    if skipped:
        upper = F.transform(names, lambda x: F.upper(x))
        keys = F.array(*map(F.lit, skipped))
        kept = F.filter(names, lambda _, i: ~F.array_contains(keys, F.concat(path_key(root), F.lit("\\"), F.array_join(F.slice(upper, F.lit(1), i + 1), "\\"))))
    else:
        kept = names
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(kept)


def canonical(folder: str, solution_folder: str) -> str:
    """The key of a configured folder: rooted or relative to the solution, with . and .. resolved, no trailing separator."""
    f = folder.replace("/", "\\")
    if not (f.startswith("\\") or f[1:2] == ":"):
        f = solution_folder.replace("/", "\\").rstrip("\\") + "\\" + f
    out: list[str] = []
    for part in f.split("\\"):
        if part == ".." and len(out) > 1:
            out.pop()
        elif part not in ("", ".", "..") or not out:
            out.append(part)
    return "\\".join(out).upper()
