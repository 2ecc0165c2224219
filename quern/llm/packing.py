"""Packing by shortest-pack-first over the length histogram.

A document is its ids and an end id, cut into pieces of at most ``size`` ids: whole ones
first, then the rest.  Only the histogram of piece lengths (at most ``size`` numbers)
reaches the driver.  There, lengths are placed from the longest to the shortest, each into
the open pack with the fewest ids so far that has room, where packs of the same make are
one *pattern* with a count: a placement moves many packs at once, and each length adds at
most two patterns.  The patterns give, for every length, which ranks go where; pieces
are ranked within their length and looked up.

Ranks need no sort: the encoding pass numbers the pieces of each length within its
partition, and the partitions' counts are added up.  Pieces are written once, so that
ranks stay the same when executors are lost.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import only, written
from quern.llm.tokens import encoder


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(count of packs, [(length, repeats), ...])] that hold every piece of the histogram."""
    heap: list[tuple[int, int, list]] = []  # (-room, number, [count, content]): the shortest pack first
    done: list[tuple[int, list[tuple[int, int]]]] = []
    number = 0

    def keep(count: int, room: int, content: list[tuple[int, int]]) -> None:
        nonlocal number
        if room == 0:
            done.append((count, content))
        else:
            number += 1
            heapq.heappush(heap, (-room, number, [count, content]))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                minus_room, _, (count, content) = heapq.heappop(heap)
                room = -minus_room
                used = min(count, left)
                if used < count:
                    keep(count - used, room, content)
                grown = [*content[:-1], (length, content[-1][1] + 1)] if content[-1][0] == length else [*content, (length, 1)]
                keep(used, room - length, grown)
                left -= used
            else:
                # no open pack has room; as many new ones as the pieces of this length need, filled evenly
                fit = size // length
                packs, rest = divmod(left, fit)
                if packs:
                    keep(packs, size - fit * length, [(length, fit)])
                if rest:
                    keep(1, size - rest * length, [(length, rest)])
                left = 0
    return done + [(count, content) for _, _, (count, content) in heap]


def places(packs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset), sorted by length and rank."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for count, content in packs:
        offset = 0
        for length, repeats in content:
            rows.append((length, at.get(length, 0), repeats, sequence, offset))
            at[length] = at.get(length, 0) + count * repeats
            offset += length * repeats
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def locate(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    shift = np.int64(1 << 44)
    k = np.searchsorted(table[:, 0] * shift + table[:, 1], length * shift + rank, side="right") - 1
    _, first, repeats, sequence, offset = table[k].T
    into = rank - first
    return sequence + into // repeats, offset + into % repeats * length


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``part``, ``local_rank`` (within part and length)."""
    slim = only(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        part, ranks = TaskContext.get().partitionId(), {}
        for b in batches:
            row, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([enc.encode(t), end]).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    n = len(piece)
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    row.append(i)
                    out.append((start, n, zlib.crc32(piece.tobytes()), len(ids), part, rank))
            columns = np.array(out, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=[key, *names])

    names = ["start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"]
    return slim.mapInArrow(run, T.StructType([slim.schema[key], *(T.StructField(c, T.LongType()) for c in names)]))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are one piece, the end id.  Null keys and repeated rows are packed like
    any.  An empty table gives no pieces.
    """
    pieces = written(cut(docs, tokenizer, end_id, size, key, text), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most size rows
    # at most 2 size patterns with 2 sqrt(size) different lengths each
    shared = docs.sparkSession.sparkContext.broadcast(places(patterns(histogram, size)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["part", "length"]).select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("earlier") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = locate(shared.value, b.column(2).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
