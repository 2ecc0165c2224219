"""Scanning and rewriting of markup bodies.

Spark has no function that gives the positions of all matches of a pattern, and patterns here
depend on the document (the alias of the markup language's own namespace), so a body is
scanned in Python, one Arrow batch at a time; everything that relates fragments of
documents to moved types is a join of relations.  Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.model import FRAGMENT, FileProcessError

# The grammar of what is recognised; names are of letters, digits and underscores.
COMMENT = r"(?s)<!--.*?-->"
LANGUAGE_2006 = r'xmlns\s?:\s?(\w+)\s?=\s?"http://schemas\.microsoft\.com/winfx/2006/xaml"'
LANGUAGE_2009 = r'xmlns\s?:\s?(\w+)\s?=\s?"http://schemas\.microsoft\.com/winfx/2009/xaml"'
MAPPING = r'xmlns\s*:\s*(\w+)\s*=\s*"(clr-namespace|using):([\w.]+)([^"]*)"'
TAG = r"<\s?(/?)\s?(\w+)\s?:\s?(\w+)"
EXTENSION = r"\{{\s?{x}:{kind}\s+(\w+)\s?:\s?(\w+)"
CLASS = r'{x}:Class\s?=\s?"([\w.]+)"'
USAGE = r"(\w+)\s*:\s*(\w+)"
ALIAS_USE = r"(\w+)\s?:"
NO_ALIAS = "NO_X_ALIAS"


@dataclass(frozen=True)
class Fragment:
    kind: str  # language, mapping, tag, extension, class, usage
    start: int
    length: int
    prefix: str = ""
    alias: str = ""
    name: str = ""
    ns: str = ""
    suffix: str = ""
    form: str = ""
    is_markup_ext: bool = False

    @property
    def end(self) -> int:
        return self.start + self.length


def comment_spans(body: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(COMMENT, body)]


def _live(pattern: str, body: str, comments: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches that do not begin in a comment; comments are in order and apart."""
    starts = [a for a, _ in comments]
    for m in re.finditer(pattern, body):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or m.start() >= comments[k][1]:
            yield m


def mappings(body: str, comments: list[tuple[int, int]]) -> list[Fragment]:
    return [Fragment("mapping", m.start(), len(m[0]), alias=m[1], form=m[2], ns=m[3], suffix=m[4]) for m in _live(MAPPING, body, comments)]


def fragments(body: str) -> list[Fragment]:
    """All fragments of a body; usages are what no other fragment occupies."""
    comments = comment_spans(body)
    language = next(_live(LANGUAGE_2006, body, comments), None) or next(_live(LANGUAGE_2009, body, comments), None)
    x = re.escape(language[1]) if language else NO_ALIAS
    found = [Fragment("language", language.start(), len(language[0]), alias=language[1])] if language else []
    found += mappings(body, comments)
    found += [Fragment("tag", m.start(), len(m[0]), prefix=m[1], alias=m[2], name=m[3]) for m in _live(TAG, body, comments)]
    for kind in ("Type", "Static"):
        found += [Fragment("extension", m.start(), len(m[0]), prefix=kind, alias=m[1], name=m[2]) for m in _live(EXTENSION.format(x=x, kind=kind), body, comments)]
    for m in _live(CLASS.format(x=x), body, comments):
        ns, _, name = m[1].rpartition(".")
        found.append(Fragment("class", m.start(), len(m[0]), alias=language[1] if language else NO_ALIAS, name=name, ns=ns))
    taken = sorted((f.start, f.end) for f in found)
    starts, ends = [a for a, _ in taken], list(accumulate((z for _, z in taken), max))
    for m in _live(USAGE, body, comments):
        k = bisect_left(starts, m.end())  # of the fragments that begin before its end, does one end after its start
        if not k or ends[k - 1] <= m.start():
            found.append(Fragment("usage", m.start(), len(m[0]), alias=m[1], name=m[2], is_markup_ext=body[: m.start()].rstrip().endswith("{")))
    return found


def used_aliases(body: str, maps: list[Fragment]) -> set[str]:
    """Every ``word:`` outside of mappings; comments count as usage."""
    at, parts = 0, []
    for m in sorted(maps, key=lambda m: m.start):
        parts += [body[at : m.start], " " * m.length]
        at = m.end
    return set(re.findall(ALIAS_USE, "".join(parts) + body[at:]))


def drop_unused(body: str) -> str:
    maps = [f for f in fragments(body) if f.kind == "mapping"]
    used = used_aliases(body, maps)
    for m in sorted(maps, key=lambda m: -m.start):
        if m.alias not in used:
            body = body[: m.start] + body[m.end :]
    return body


def _alias(path: str, target: str, suffix: str) -> str:
    return target.rpartition(".")[2] + hashlib.sha256(f"{path}|{target}|{suffix}".encode()).hexdigest()[:8]


def move_class(body: str, source: str, name: str, target: str, path: str = "") -> str:
    """The body after a class has moved from one namespace to another.

    References go to a mapping of the target in the same assembly (same suffix), which is made
    where there is none, of the same form; mappings that nothing uses any more are dropped.
    """
    found = fragments(body)
    maps = [f for f in found if f.kind == "mapping"]
    by_alias = {m.alias: m for m in reversed(maps)}  # the first of an alias wins
    by_target = {(m.ns, m.suffix): m.alias for m in reversed(maps)}
    new: dict[tuple[str, str], Fragment] = {}
    edits: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda f: -f.start):
        if f.kind == "class":
            if (f.ns, f.name) == (source, name):
                edits.append((f.start, f.end, f'{f.alias}:Class="{target}.{name}"'))
            continue
        if f.kind not in ("tag", "extension", "usage") or not (f.name == name or f.is_markup_ext and f.name + "Extension" == name):
            continue
        m = by_alias.get(f.alias)
        if m is None or m.ns != source:
            continue
        key = (target, m.suffix)
        if key not in by_target:
            new[key] = replace(m, alias=_alias(path, target, m.suffix), ns=target)
            by_target[key] = new[key].alias
        alias = by_target[key]
        if f.kind == "tag":
            text = f"<{f.prefix}{alias}:{f.name}"
        elif f.kind == "extension":
            text = f"{{{next(x.alias for x in found if x.kind == 'language')}:{f.prefix} {alias}:{f.name}"
        else:
            text = f"{alias}:{f.name}"
        edits.append((f.start, f.end, text))
    if not edits:
        return body
    for a, z, text in edits:  # backwards, so earlier positions stay valid
        body = body[:a] + text + body[z:]
    at = max((m.end for m in mappings(body, comment_spans(body))), default=None)
    if at is not None:
        body = body[:at] + "".join(f' xmlns:{m.alias}="{m.form}:{m.ns}{m.suffix}"' for m in new.values()) + body[at:]
    return drop_unused(body)


def move_root(body: str, target: str, path: str = "") -> str:
    """The body after its root class, the first one stated, has moved to a namespace."""
    root = next((f for f in fragments(body) if f.kind == "class"), None)
    return body if root is None or root.ns == target else move_class(body, root.ns, root.name, target, path)


def of_file(path: str, work: Callable, *args):
    """work(*args), with a failure bound to the file."""
    try:
        return work(*args)
    except Exception as e:
        raise FileProcessError(path, f"{type(e).__name__}: {e}") from e


def scan(bodies: DataFrame) -> DataFrame:
    """FRAGMENT rows of (path, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, f.kind, f.start, f.length, f.prefix, f.alias, f.name, f.ns, f.suffix, f.form, f.is_markup_ext) for p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if body for f in of_file(p, fragments, body)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6, pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FRAGMENT.split(", ")])

    return bodies.select("path", "body").mapInArrow(run, FRAGMENT)


def matches(bodies: DataFrame, pattern: str) -> DataFrame:
    """(path, start, len, groups) of all matches of one pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, m.start(), len(m[0]), [g or "" for g in m.groups()]) for p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if body for m in re.finditer(pattern, body)]
            kinds = [b.column(0).type, pa.int32(), pa.int32(), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "len", "groups"])

    slim = bodies.select("path", "body")
    return slim.mapInArrow(run, f"path {slim.schema['path'].dataType.simpleString()}, start int, len int, groups array<string>")
