"""License scans by diagonal voting.

Templates are word sequences: short phrases, which must stand whole, and longer notices,
which may be altered here and there.  Every rolling word k-gram of a text is hashed and
joined (in Spark) to the template positions of the same hash.  A match of text position p
with template position q votes for the diagonal ``p - q``; votes are counted per text,
template and diagonal.  A phrase has all its grams on one diagonal.  For a notice, neighbouring
diagonals (a band of ``drift + 1``) are one candidate, with words put in or left out.

A candidate is verified by aligning it: of the matches in its band, the longest chain that moves
forward in the text and in the template.  Template positions hit twice count once there, and
words in another order do not count.  ``share`` is the chain's length over the
template's grams.  Since a chain stays in its band, its span is at most ``drift`` words longer
than the template, however often parts of the notice repeat around it.  Of overlapping spans of
one template the best stays, of equals the first.

The texts stay where they are.  Before grams become rows, those whose hash is of no
template are left out (a semi-join against the templates, which are a parameter of bounded
size), since an inner join would drop them anyway.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import as_bytes, only, split_alnum, written


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool  # a phrase: all its words, consecutively


#: The phrases and labels that the base counts.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
#: Well-known notices, in their usual words.
NOTICES = (
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", False),
    Template("mit-release", "Released under the MIT License", False),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", False),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", False),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", False),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", False),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", False),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", False),
    Template("cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", False),
    Template("all-rights-reserved", "All rights reserved", False),
)
GRAM = 2
MOST_TEMPLATE_WORDS = 200_000


def _hash(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Codes of the rolling k-grams over a vocabulary of template words; 0 where a word is in no template."""
    get = number.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    code, all_known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        code = code * (len(number) + 1) + part
        all_known &= part > 0
    return np.where(all_known, code, 0)


def longest_chain(band: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Of the matches (p, q) on the diagonals [(d, [q, ...])], the longest chain that grows in both; the first such by its ends."""
    matches = sorted(((q, -(d + q)) for d, qs in band for q in qs))  # of one q the latest p first, so that a chain takes one of them
    ends: list[int] = []  # least p that ends a chain of each length
    at: list[int] = []  # which match that is
    before = [-1] * len(matches)
    for i, (_, minus_p) in enumerate(matches):
        k = bisect_left(ends, -minus_p)
        before[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(-minus_p)
            at.append(i)
        else:
            ends[k], at[k] = -minus_p, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append((-matches[i][1], matches[i][0]))
        i = before[i]
    return chain[::-1]


class Best:
    """Verified spans of rows (row, template, diagonal, positions) that come in that order; holds one band at a time."""

    def __init__(self, sizes: dict[int, tuple[int, int]], drift: int, least_share: float) -> None:
        self.sizes, self.drift, self.least_share = sizes, drift, least_share
        self.of: tuple[int, int] | None = None
        self.band: list[tuple[int, list[int]]] = []
        self.open: tuple[float, int, int] | None = None  # (share, first, last)
        self.out: list[tuple] = []

    def add(self, row: int, template: int, d: int, q: list[int]) -> None:
        if (row, template) != self.of:
            self.close()
            self.of = row, template
        words, grams = self.sizes[template]
        width = band_width(words, self.drift)
        self.band = [x for x in self.band if x[0] >= d - width]
        self.band.append((d, q))
        if len(set().union(*(x[1] for x in self.band))) < self.least_share * grams:
            return
        chain = longest_chain(self.band)
        share = len(chain) / grams
        if share >= self.least_share:
            new = share, chain[0][0], chain[-1][0] + GRAM - 1
            if self.open and new[1] > self.open[2]:
                self._hand_out()
            if not self.open or share > self.open[0]:
                self.open = new

    def _hand_out(self) -> None:
        share, first, last = self.open
        self.out.append((*self.of, first, last, share))
        self.open = None

    def close(self) -> None:
        if self.open:
            self._hand_out()
        self.band = []

    def spans(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 5
        self.out = []
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row_id", "template", "first", "last", "share"])


def band_width(words: int, drift: int) -> int:
    """Words that may be put in or left out; fewer in short templates."""
    return min(drift, (words - 1) // 2)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, key: str = "doc_id", text: str = "text", drift: int = 3, least_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).

    rows: key, ``row_id``, ``n_words`` for every input row.  spans: ``row_id``, ``template``, ``label``,
    ``exact``, ``first``, ``last`` (word positions, inclusive) and ``share``.  row_id tells
    repeated or null keys apart.  Null and empty texts have no words and no spans; an empty table gives two
    empty ones.  Texts of any length are read whole; a text's matches are worked on a band at a time.
    """
    spark = docs.sparkSession
    words_of = [split_alnum(t.text.encode()) for t in templates]
    if sum(map(len, words_of)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    number: dict[bytes, int] = {}
    for w in (w for x in words_of for w in x):
        number.setdefault(w, len(number) + 1)
    grams = [_hash(x, number) for x in words_of]
    wanted = np.unique(np.concatenate([g for g in grams] or [np.empty(0, np.int64)]))
    shared = spark.sparkContext.broadcast((number, wanted[wanted > 0]))
    positions = spark.createDataFrame([(int(g), t, q) for t, x in enumerate(grams) for q, g in enumerate(x)] or [], "gram long, template int, q int")
    facts = spark.createDataFrame([(t, x.label, x.exact, len(words_of[t]), len(grams[t])) for t, x in enumerate(templates)], "template int, label string, exact boolean, n_template int, n_grams int")

    slim = only(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wanted = shared.value
        for b in batches:
            n_words, at, codes = [], [], []
            for t in as_bytes(b.column(1)):
                words = split_alnum(t or b"")
                g = _hash(words, number)
                found = np.flatnonzero(g)
                found = found[np.isin(g[found], wanted)] if len(found) else found
                n_words.append(len(words))
                at.append(found)
                codes.append(g[found])
            offsets = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64))) for x in (at, codes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *lists], names=[key, "n_words", "p", "gram"])

    longs = T.ArrayType(T.LongType())
    found = slim.mapInArrow(run, T.StructType([slim.schema[key], T.StructField("n_words", T.LongType()), T.StructField("p", longs), T.StructField("gram", longs)]))
    rows = written(found.withColumn("row_id", F.monotonically_increasing_id()), "license-grams")

    votes = rows.where(F.size("p") > 0).select("row_id", F.explode(F.arrays_zip("p", "gram")).alias("m")).select("row_id", F.col("m.p").alias("p"), F.col("m.gram").alias("gram"))
    on_diagonal = votes.join(F.broadcast(positions), "gram").withColumn("d", F.col("p") - F.col("q"))  # template positions: at most MOST_TEMPLATE_WORDS
    # a diagonal holds a template position once, so these lists are as long as a template at most
    diagonals = on_diagonal.groupBy("row_id", "template", "d").agg(F.sort_array(F.collect_set("q")).alias("q")).join(F.broadcast(facts), "template")
    whole = diagonals.where(F.col("exact") & (F.size("q") == F.col("n_grams"))).select("row_id", "template", "label", "exact", F.col("d").alias("first"), (F.col("d") + F.col("n_template") - 1).alias("last"), F.lit(1.0).alias("share"))
    sizes = {t: (len(words_of[t]), len(g)) for t, g in enumerate(grams)}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sizes, drift, least_share)
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                best.add(*row)
            yield best.spans()
        best.close()
        yield best.spans()

    # a row_id is one text: its diagonals come in order to one task, which holds a band at a time
    near = diagonals.where(~F.col("exact")).select("row_id", "template", F.col("d").cast("long").alias("d"), "q").repartition("row_id").sortWithinPartitions("row_id", "template", "d")
    kept = near.mapInArrow(verify, "row_id long, template int, first long, last long, share double").join(F.broadcast(facts), "template")
    return rows.select(key, "row_id", "n_words"), whole.unionByName(kept.select("row_id", "template", "label", "exact", "first", "last", "share"))


def summarise(rows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per input row: places of phrases, their first and last start, labels (phrases' and all), the best share.

    Repeated rows and null keys have a row each.
    """
    base = F.col("exact")
    by_row = spans.groupBy("row_id").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base"), F.array_sort(F.collect_set("label")).alias("all"), F.max("share").alias("score"),
    )
    out = rows.join(by_row, "row_id", "left")
    return out.select(key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
