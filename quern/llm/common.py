"""What the operators of this subpackage share: word splitting, the fold rule, slices of batches.

Words.  Two rules are used.  ``split_ws`` cuts at ASCII white space only
(``[^\\x20\\x09-\\x0D]+``), ``split_alnum`` keeps digits, letters and everything above
ASCII (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z).  Both work on the
UTF-8 bytes, where ``bytes.lower`` and ``bytes.split`` know ASCII only: this is
exactly what the rules ask for, and needs no regular expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import work_folder, written  # noqa: F401  (handed on)

SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
ALNUM_TABLE = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))


def split_ws(text: bytes, lower: bool = True) -> list[bytes]:
    return (text.lower() if lower else text).split()


def split_alnum(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


#: Rows that are worked on at once, and the bytes from which fewer are.
SLICE_ROWS, SLICE_BYTES = 1000, 16_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (views), so that what is made of a batch stays small beside it."""
    for b in batches:
        rows = SLICE_ROWS if b.nbytes <= SLICE_BYTES else max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers live on; what a task held must not stay with them


def in_training_fold(doc_id: Column | str = "doc_id") -> Column:
    """Labels may be learnt from a row only where this holds: crc32 of the id as text, mod 5, is not 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % 5 != 0


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(~in_training_fold(doc_id), F.lit(False))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra columns of the input, whatever they are called, play no part."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs through run, which keeps the columns; these may have any names, dots and clashes included."""
    names = docs.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, docs.schema)
