"""Statistics of whole texts, computed once a text and shared by the quality operators.

One ``mapInArrow`` pass reads (key, text) and returns the key with a fixed set of numbers;
texts are never shuffled.  Null and empty texts have zero for every count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import as_bytes, only

SYMBOLS = b"#*$%&|<>"
#: The counts that contracts fix, then further counts for learning.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_pipes", "n_bangs", "n_distinct", "n_twin_words", "n_ends")
COUNTS = BASE + MORE

_SPACES = b" \t\n\x0b\x0c\r"
_NOT_LEAD = bytes(range(0x80, 0xC0))
_KEEP_LETTERS = re.compile(rb"[A-Z]")


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """Words that lie in a window of so many words found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    if distinct**window < 1 << 62:
        codes = np.zeros(n, np.int64)
        for k in range(window):
            codes = codes * distinct + ids[k : k + n]
    else:  # more distinct words than a 64-bit code can hold: number the pairs first
        codes = ids
        for k in range(1, window):
            codes = np.unique(codes[:-1] * np.int64(distinct) + ids[k : k + len(codes) - 1], return_inverse=True)[1]
    _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes | None) -> list[int]:
    """The numbers of COUNTS, in that order."""
    if not text:
        return [0] * len(COUNTS)
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n_chars = len(text.translate(None, _NOT_LEAD))  # code points: bytes that are not continuations
    n_spaces = len(text) - len(text.translate(None, _SPACES))
    lines = [x for x in text.split(b"\n")]
    full = [x for x in lines if x.strip(_SPACES)]
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return [
        len(words), n_chars - n_spaces, int(sum(by_byte[c] for c in SYMBOLS)), len(full) - len(set(full)), repeated_words(ids, len(number)),
        n_chars, len(lines), int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[48:58].sum()), int(by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum()),
        int(by_byte[124]), int(by_byte[33]), len(number), int((ids[1:] == ids[:-1]).sum()), int(by_byte[46]),
    ]


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS...) with one row per input row, keys as they are (null and repeated ones too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t) for t in as_bytes(b.column(1))], np.int64).reshape(b.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(COUNTS)))], names=[key, *COUNTS])

    slim = only(docs, key, text)
    return slim.mapInArrow(run, T.StructType([slim.schema[key], *(T.StructField(c, T.LongType(), False) for c in COUNTS)]))
