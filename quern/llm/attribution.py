"""Token counts of a document's sections, by offset-mapped attribution.

A whole document is encoded once, so tokens are those that training will see, and not those of
sections encoded apart.  Each token has a span of the text; spans are joined to the
sections' intervals.  A token that crosses a border goes, whole, to the section that
holds most of it, and to the earlier one of equals; counts of sections therefore add up to
the document's tokens.

Spans are counted in UTF-8 bytes: a byte-level token is a run of bytes and may end inside a
character.  They follow from the ids alone, since the tokens of a text, put together, are the
text: the span of a token ends where the lengths so far add up to.  For files that are not
byte-level, the library's character offsets are turned into bytes.  Both sides of the join are
ordered, so it is a binary search of borders among span ends, text by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import only
from quern.llm.tokens import Encoder, encoder

#: Documents of one output batch.
AT_ONCE = 1000


def lines(text: bytes) -> np.ndarray:
    """Where lines begin, in bytes: after each line break, which belongs to the line it ends. An empty last line is none."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(text)]])


def _token_lengths(enc: Encoder) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary, whose tokens have a letter for each byte."""
    out = np.zeros(enc.size, np.int64)
    for token, i in enc.tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in enc.tokenizer.get_added_tokens_decoder().items():  # these stand for their own strings
        out[i] = len(token.content.encode())
    return out


def token_ends(enc: Encoder, lengths: np.ndarray | None, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the tokens' spans in bytes."""
    if lengths is not None:
        ends = np.cumsum(lengths[enc.encode(text)])
        return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends
    offsets = np.array(enc.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # where characters begin
    at = np.append(lead, len(raw))
    return at[offsets[:, 0]], at[offsets[:, 1]]


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, those of them that cross a border); sections run from border to border, the last to size."""
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.maximum(first, np.searchsorted(borders, ends, side="left") - 1)
    owner = first.copy()
    edges = np.append(borders, size)
    for k in np.flatnonzero(last > first):
        held = np.minimum(edges[first[k] + 1 : last[k] + 2], ends[k]) - np.maximum(edges[first[k] : last[k] + 1], starts[k])
        owner[k] = first[k] + int(np.argmax(held))  # the earliest of the largest
    n = len(borders)
    return np.bincount(owner, minlength=n), np.bincount(owner[last > first], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str, sections: Callable[[bytes], np.ndarray] = lines, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``section`` (from 0), ``start_byte``, ``end_byte``, ``n_tokens``, ``n_crossing``, one row per section.

    sections gives the first bytes of a text's sections, in order, beginning with 0.  Null and empty texts
    have one empty section.  Null keys and repeated rows are kept.
    """
    slim = only(docs, key, text)
    numbers = ("section", "start_byte", "end_byte", "n_tokens", "n_crossing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        lengths = _token_lengths(enc) if enc.kind == "bytes" else None
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                row, out = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    borders = sections(raw) if raw else np.zeros(1, np.int64)
                    counts = attribute(*token_ends(enc, lengths, t, raw), borders, len(raw)) if raw else (np.zeros(1, np.int64),) * 2
                    n = len(borders)
                    row.append(np.full(n, i))
                    out.append(np.stack([np.arange(n), borders, np.append(borders[1:], len(raw)), *counts]))
                table = np.concatenate(out, axis=1).astype(np.int64) if out else np.empty((len(numbers), 0), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate([*row, np.empty(0, np.int64)]).astype(np.int64))), *(pa.array(c) for c in table)], names=[key, *numbers])

    return slim.mapInArrow(run, T.StructType([slim.schema[key], *(T.StructField(c, T.LongType()) for c in numbers)]))
