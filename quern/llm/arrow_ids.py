"""Token ids as Arrow stream files of fixed-size lists.

Documents are encoded in ascending key order, each followed by an end id, as one long
stream of ids.  Every Spark partition of the range-sorted table writes one pair of files:

* ``part-N.arrows``: record batches of (ids: fixed_size_list<uint16 or uint32>[length],
  mask: fixed_size_list<bool>[length]).  All sequences have one length; the last of a part is
  padded, its mask tells.  Batches hold equally many sequences, nothing is compressed, so a
  memory-mapped file gives any sequence without a copy (``SequenceFile``).
* ``part-N.docs.arrows``: (key, start, n_tokens) of each document; start counts the part's own ids.

A file gets its name only when it is complete, and a repeated task writes the same
bytes, so lost executors do no harm.  The driver keeps one line a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import only, work_folder
from quern.llm.tokens import encoder

SEQUENCES_PER_BATCH = 64


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class PartWriter:
    """One part's pair of files; ids are handed on batch by batch."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int, key: pa.DataType) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.attempt = f"{name}.attempt-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.name, self.kind, self.length = name, kind, length
        self.out = {end: self.fs.open_output_stream(f"{self.root}/.{self.attempt}{end}") for end in (".arrows", ".docs.arrows")}
        self.ids = pa.ipc.new_stream(self.out[".arrows"], _schema(kind, length))
        self.docs = pa.ipc.new_stream(self.out[".docs.arrows"], pa.schema([("key", key), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.pending: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0

    def add(self, keys: pa.Array, rows: list[np.ndarray]) -> None:
        lengths = np.array([len(r) for r in rows], np.int64)
        starts = self.total + np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(rows) else np.empty(0, np.int64)
        self.docs.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts.astype(np.int64)), pa.array(lengths)], names=["key", "start", "n_tokens"]))
        self.total += int(lengths.sum())
        self.n_docs += len(rows)
        full = SEQUENCES_PER_BATCH * self.length
        for r in rows:
            self.pending.append(r)
            self.held += len(r)
            if self.held >= full:
                self._flush(full)

    def _flush(self, full: int) -> None:
        flat = np.concatenate(self.pending)
        for at in range(0, len(flat) - full + 1, full):
            self._write(flat[at : at + full], full)
        rest = flat[len(flat) // full * full :]
        self.pending, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self.kind.to_pandas_dtype())
        padded[: len(ids)] = ids
        mask = np.arange(size) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=_schema(self.kind, self.length)))

    def close(self) -> tuple[int, int]:
        if self.held:
            flat = np.concatenate(self.pending)
            self._write(flat, -(-len(flat) // self.length) * self.length)
        for w in (self.ids, self.docs):
            w.close()
        for end, out in self.out.items():
            out.close()
            self.fs.move(f"{self.root}/.{self.attempt}{end}", f"{self.root}/{self.name}{end}")
        return self.n_docs, self.total


class SequenceFile:
    """Random access to the sequences of one part; local files are memory-mapped and not copied."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        source = pa.memory_map(f"{root}/{name}.arrows") if local else fs.open_input_file(f"{root}/{name}.arrows")
        self.batches = list(pa.ipc.open_stream(source))
        self.docs = pa.ipc.open_stream(fs.open_input_stream(f"{root}/{name}.docs.arrows"))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.flat = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]
        self.per_batch = SEQUENCES_PER_BATCH * self.length
        self.n_sequences = sum(b.num_rows for b in self.batches)
        self.n_ids = sum(b.column("mask").values.true_count for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of the i-th sequence; the ids are a view of the file."""
        b, k = divmod(i, SEQUENCES_PER_BATCH)
        return self.flat[b][k * self.length : (k + 1) * self.length], self.batches[b].column("mask")[k].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids of the stream, from any place; a view where one batch has them all."""
        b, at = divmod(start, self.per_batch) if n else (0, 0)
        parts = []
        while n > 0:
            part = self.flat[b][at : at + n]
            parts.append(part)
            n -= len(part)
            b, at = b + 1, 0
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.uint32)])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", length: int = 2048) -> tuple[str, list[tuple[str, int, int]]]:
    """Write the files; returns the folder and (part, documents, ids) in key order, one line a partition.

    Null and empty texts are the end id alone.  Null keys come first; rows of one key are
    ordered by their text.  Parts without rows write no file.
    """
    slim = only(docs, key, text)
    folder = folder or work_folder(docs.sparkSession, "token-ids")
    ordered = slim.repartitionByRange(key).sortWithinPartitions(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = pa.uint16() if max(enc.size, end_id + 1) <= 1 << 16 else pa.uint32()
        end = np.array([end_id], np.uint32)
        writer, part = None, TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 500):  # a few texts at a time: long texts stay few in memory
                s = b.slice(at, 500)
                if writer is None:
                    writer = PartWriter(folder, f"part-{part:06d}", kind, length, s.column(0).type)
                writer.add(s.column(0), [np.concatenate([enc.encode(t), end]).astype(kind.to_pandas_dtype()) for t in s.column(1).to_pylist()])
        if writer is not None:
            n_docs, total = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.name]), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], names=["part", "name", "n_docs", "n_ids"])

    manifest = ordered.mapInArrow(run, "part long, name string, n_docs long, n_ids long").collect()  # one line a partition
    return folder, [(r["name"], r["n_docs"], r["n_ids"]) for r in sorted(manifest, key=lambda r: r["part"])]


def read_back(docs: DataFrame, folder: str, parts: list[tuple[str, int, int]], key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files alone; docs gives only the key's type."""
    spark = docs.sparkSession
    kind = docs.schema[key]
    schema = T.StructType([kind, *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    rows, at = [], 0
    for name, _, n_ids in parts:
        rows.append((name, at))
        at += n_ids
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "name string, earlier long").repartition(len(rows), F.col("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, earlier in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = SequenceFile(folder, name)
                for d in file.docs:
                    starts, sizes = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(file.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column("key"), pa.array(starts + earlier), d.column("n_tokens"), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, schema)
