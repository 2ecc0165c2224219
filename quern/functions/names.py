"""Namespace and type name expressions; names compare case-sensitively."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First parts of namespaces that are never moved.
SPECIAL = ("System", "Microsoft")
#: Presets for the rename: the whole name, its first part, its last part.
PRESETS = {"whole": "^.+$", "first": "^[^.]+", "last": "[^.]+$"}
GLOBAL = "global::"


def first_part(ns: Column) -> Column:
    return F.substring_index(ns, ".", 1)


def is_special(ns: Column) -> Column:
    return first_part(ns).isin(*SPECIAL)


def nested_in(scope: Column, ns: Column) -> Column:
    return (scope == ns) | scope.startswith(F.concat(ns, F.lit(".")))


def default_fallback(project_name: Column) -> Column:
    """The project's name without its last part; as it is without a dot, or with a leading dot only."""
    return F.regexp_replace(project_name, r"^(.+)\.[^.]*$", "$1")


def without_framework(project_name: Column) -> Column:
    """Without the `` (framework)`` tail of a multi-target project."""
    at = F.instr(project_name, " (")
    return F.when(at > 1, F.substring(project_name, F.lit(1), at - 1)).otherwise(project_name)


def replacement_for_java(replacement: str, groups: int) -> str:
    """A .NET replacement pattern in Java's words: unknown group numbers and backslashes are literal there."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\":
            out.append("\\\\")
        elif c != "$":
            out.append(c)
        elif replacement[i + 1 : i + 2] == "$":
            out.append("\\$")
            i += 1
        elif replacement[i + 1 : i + 2] == "&":
            out.append("$0")
            i += 1
        elif (m := re.match(r"\$(\d+)", replacement[i:])) and int(m[1]) <= groups:
            out.append(f"${m[1]}")
            i += len(m[0]) - 1
        elif (m := re.match(r"\$\{(\d+)\}", replacement[i:])) and int(m[1]) <= groups:
            out.append(f"${m[1]}")
            i += len(m[0]) - 1
        else:
            out.append("\\$")
        i += 1
    return "".join(out)


def rename(ns: Column, pattern: str, replacement: str) -> Column:
    """Replaces all matches; an empty pattern or replacement switches it off, a broken pattern changes nothing."""
    if not pattern or not replacement:
        return ns
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return ns
    return F.regexp_replace(ns, F.lit(pattern), F.lit(replacement_for_java(replacement, groups)))


def compose(default_ns: Column, chain: Column, pattern: str = "", replacement: str = "") -> Column:
    return rename(F.array_join(F.concat(F.array(default_ns), chain), "."), pattern, replacement)


def normal_using(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s", ""), f"^{GLOBAL}", "")


def transition(parts: Column, file_scoped: Column, target: Column) -> Column:
    """struct(original, modified, is_root): only the outermost written name is replaced; null where nothing changes."""
    original = F.array_join(parts, ".")
    modified = F.when(file_scoped, target).otherwise(F.array_join(F.concat(F.array(target), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), "."))
    return F.when(original != modified, F.struct(original.alias("original"), modified.alias("modified"), (F.size(parts) == 1).alias("is_root")))


def moved_name(full: Column, ns: Column, target: Column) -> Column:
    """A type's full name in another namespace."""
    return F.when(full.startswith(F.concat(ns, F.lit("."))), F.concat(target, F.lit("."), F.substring(full, F.length(ns) + 2, F.length(full)))).otherwise(full)


def scope_prefixes(scope: Column) -> Column:
    """'' and every dotted prefix of a scope."""
    parts = F.split(F.coalesce(scope, F.lit("")), r"\.")
    return F.concat(F.array(F.lit("")), F.when(F.coalesce(scope, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))


def is_shadowed(target: Column, type_name: Column, scope: Column) -> Column:
    """A namespace on the way from the scope outwards has the type's name and leads to the target."""

    def leads(prefix: Column) -> Column:
        candidate = F.when(prefix == "", type_name).otherwise(F.concat(prefix, F.lit("."), type_name))
        return (target == candidate) | target.startswith(F.concat(candidate, F.lit(".")))

    return F.coalesce((F.length(target) > 0) & (F.length(type_name) > 0) & F.exists(scope_prefixes(scope), leads), F.lit(False))


def split_last_dot(name: Column) -> tuple[Column, Column]:
    """(namespace, simple name); the namespace of an undotted name is empty."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.regexp_extract(name, r"([^.]*)$", 1)


def new_alias(path: Column, target: Column, suffix: Column) -> Column:
    """The target's last word and 8 hex digits that depend on place and target alone."""
    return F.concat(F.substring_index(target, ".", -1), F.substring(F.sha2(F.concat_ws("|", path, target, suffix), 256), 1, 8))


def type_conflict(ns: Column, name: Column) -> Column:
    return F.format_string("'%s' already contains a type '%s'", ns, name)
