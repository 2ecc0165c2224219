"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised to word sequences and put into one suffix automaton, over word
numbers.  A text streams through it: after each word the automaton knows the longest run of
words ending there that occurs inside some item.  Where that run is as long as a window (13
words, or a whole shorter item), the words of the window are hit.  Most words of a text are in
no item, and the longest matching run cannot cross them; only runs of known words that are
long enough reach the automaton at all.

A benchmark of up to BENCHMARK_WORDS words is one automaton, broadcast.  That is checked.  A larger one stays
in Spark: hashes of its windows are joined with those of the texts (a broadcast filter of fixed size
spares most of these the shuffle), which names the items that each text may share a window
with, and each task builds the automaton of the items that its texts need, some texts at a time.

A text is contaminated if its hit words are at least a twentieth of its words.  Cleaning
removes hit spans from such texts, and drops a text of which half or more would go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ALNUM_TABLE, as_bytes, only, slices, split_alnum, written

#: Words of the largest benchmark whose automaton is broadcast; it has at most twice as many states.
BENCHMARK_WORDS = 400_000
#: Bits of the filter of window hashes; beside a larger benchmark more windows pass and are joined away.
FILTER_BITS = 1 << 27


class SuffixAutomaton:
    """Over the word numbers of several items; no match crosses from one item into another."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.short: dict[int, set[str]] = {}  # state of a whole item shorter than the window -> its ids
        self.items: dict[int, set[str]] = {}  # state of a window -> ids of the items that hold it
        for name, words in items:
            last = 0
            for w in words:
                last = self._add(last, w)
            if 0 < len(words) < window:
                self.short.setdefault(last, set()).add(name)
        for name, words in items:
            if len(words) >= window:
                state = length = 0
                for w in words:
                    state, length = self.step(state, length, w)
                    if length >= window:
                        self.items.setdefault(self.cut(state, window), set()).add(name)
        # the nearest state up the links, itself included, that is a whole short item
        self.up = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]]
        self.least = min([window, *(self.length[s] for s in self.short)]) if items else window

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the automaton may have this path from an earlier item
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._new(self.length[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest run ending with w that occurs in an item: its state and length."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], length + 1
        return 0, 0

    def cut(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a run that is at least so long."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of each window that occurs; end is exclusive."""
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length >= self.window:
                yield i + 1, self.window, self.items[self.cut(state, self.window)]
            s = self.up[state] if length else -1
            if s == state and length < self.length[s]:
                s = self.up[self.link[s]]
            while s > 0:
                yield i + 1, self.length[s], self.short[s]
                s = self.up[self.link[s]]


@dataclass
class Block:
    number: dict[bytes, int]
    automaton: SuffixAutomaton


@dataclass
class Found:
    n_words: int
    hit: np.ndarray  # of each word
    items: list[str]
    longest: int


def build(items: list[tuple[str, bytes]], window: int) -> Block:
    number: dict[bytes, int] = {}
    rows = [(name, [number.setdefault(w, len(number) + 1) for w in split_alnum(text)]) for name, text in items]
    return Block(number, SuffixAutomaton(rows, window))


def n_words(benchmark: DataFrame, text: str) -> int:
    """Words of all items, counted in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(split_alnum(t or b"")) for t in as_bytes(b.column(0)))], pa.int64())], names=["n"])

    return only(benchmark, text).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _named(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("body"))


def window_hashes(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words."""
    if len(words) < n or not n:
        return np.empty(0, np.uint64)
    seen: dict[bytes, int] = {}
    h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    acc = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(acc)]
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return acc ^ (acc >> np.uint64(32))


def with_items(docs: DataFrame, benchmark: DataFrame, text: str, item: str, window: int) -> DataFrame:
    """docs with ``row_id`` and ``items``: (item, body) of each item that may share a window with the text; null where there is none.

    Columns of docs are named c0, c1, ...  Texts stay where they
    are but for those that share a window.
    """
    spark = docs.sparkSession
    named = written(_named(benchmark, item, text), "items")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, hashes = [], [], []
            for name, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = split_alnum(raw)
                n = min(window, len(words))
                for h in np.unique(window_hashes(words, n)).view(np.int64).tolist():
                    names.append(name)
                    sizes.append(n)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["item", "n", "h"])

    windows = written(named.mapInArrow(item_windows, "item string, n int, h long").distinct(), "windows")
    sizes = sorted(r["n"] for r in windows.select("n").distinct().toLocalIterator())  # at most `window` of them
    at = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for b in windows.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        bits[b.column(0).to_numpy()] = b.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((sizes, bits))
    # the input is written with its row numbers, so that these stay the same when a task is run again
    rows = written(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    column = f"c{docs.columns.index(text)}"

    def text_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = shared.value
        for b in slices(batches):
            ids, hashes = [], []
            for i, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = split_alnum(raw or b"")
                for n in sizes:
                    h = window_hashes(words, n)
                    place = (h.view(np.int64) % FILTER_BITS).astype(np.int64)
                    h = np.unique(h[(bits[place >> 6] >> (place & 63)) & 1 == 1])
                    ids += [i] * len(h)
                    hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]))], names=["row_id", "h"])

    near = rows.select("row_id", column).mapInArrow(text_windows, "row_id long, h long").join(windows.select("item", "h"), "h").select("row_id", "item").distinct()
    # of equal ids every text counts
    items = near.join(named, "item").groupBy("row_id").agg(F.collect_list(F.struct("item", "body")).alias("items"))
    return rows.join(items, "row_id", "left").select(*rows.columns, "items")


def look(words: list[bytes], block: Block) -> Found:
    n = len(words)
    hit = np.zeros(n, bool)
    items: set[str] = set()
    longest = 0
    least, get = block.automaton.least, block.number.get
    if n >= least:
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        # runs of known words, at least as long as the shortest window
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        for a, z in edges.reshape(-1, 2):
            if z - a >= least:
                for end, length, names in block.automaton.matches(ids[a:z].tolist()):
                    hit[a + end - length : a + end] = True
                    items |= names
    if hit.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
        longest = int((edges[1::2] - edges[::2]).max())
    return Found(n, hit, sorted(items), longest)


def _word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end."""
    flat = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat, [0]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def cleaned(text: bytes, block: Block, coverage: float) -> bytes | None:
    """The text without hit spans; None if they cover so much of it.  Cutting may bring new windows together, so it is repeated."""
    whole = None
    while True:
        found = look(split_alnum(text), block)
        n = int(found.hit.sum())
        whole = whole or found.n_words
        if not n:
            return text
        if found.n_words - n <= (1 - coverage) * whole:
            return None
        starts, ends = _word_spans(text)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], found.hit, [0]]).astype(np.int8))).reshape(-1, 2)
        parts, at = [], 0
        for a, z in edges:
            parts.append(text[at : starts[a]])
            at = ends[z - 1]
        parts.append(text[at:])
        text = b"\n".join(parts)


def _looked(docs: DataFrame, benchmark: DataFrame, text: str, item: str, window: int, schema: T.StructType, work: Callable[[pa.RecordBatch, Block], pa.RecordBatch]) -> DataFrame:
    """work on batches of docs, each with an automaton of all items that its texts may hold."""
    spark = docs.sparkSession
    width = len(docs.columns)
    if n_words(benchmark, text) <= BENCHMARK_WORDS:
        rows = [(r["item"], r["body"].encode("utf-8", "surrogatepass")) for r in _named(benchmark, item, text).orderBy("item", "body").toLocalIterator()]  # at most BENCHMARK_WORDS words
        shared = spark.sparkContext.broadcast(build(rows, window))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield work(b, shared.value)

        return docs.toDF(*(f"c{i}" for i in range(width))).mapInArrow(whole, schema)
    empty = build([], window)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            items = b.column(width + 1)
            # texts without a near item need no automaton; the others share that of all their items
            wanted = {(x["item"], x["body"]) for row in items.to_pylist() for x in row or ()}
            block = build([(name, body.encode("utf-8", "surrogatepass")) for name, body in sorted(wanted)], window) if wanted else empty
            yield work(b.select(list(range(width))), block)

    return with_items(docs, benchmark, text, item, window).mapInArrow(some, schema)


def is_contaminated(n_hit: int, n_words: int, parts: int = 20) -> bool:
    return n_hit > 0 and parts * n_hit >= n_words


def measure(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 13) -> DataFrame:
    """Key, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``longest`` (hit run), one row per input row.

    Null and empty texts have no words, long ones are read whole; items without words have no windows.
    Items with equal texts count each.  A null item_id counts as the empty string; repeated ids count once,
    with the windows of all their texts.  Null keys and repeated rows are measured like any.  Extra
    columns are ignored.  Without items nothing is hit; an empty table gives an empty result.
    """
    slim = only(docs, key, text)
    number = T.LongType()
    schema = T.StructType([slim.schema[key], *(T.StructField(c, number) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("longest", number)])
    names = [f.name for f in schema]

    def work(b: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        found = [look(split_alnum(t or b""), block) for t in as_bytes(b.column(1))]
        n_hit = [int(f.hit.sum()) for f in found]
        columns = [[f.n_words for f in found], n_hit, [len(f.items) for f in found]]
        digests = [hashlib.sha256(",".join(f.items).encode("utf-8", "surrogatepass")).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array([is_contaminated(h, f.n_words) for h, f in zip(n_hit, found, strict=True)], pa.bool_()), pa.array([f.longest for f in found], pa.int64())], names=names)

    return _looked(slim, benchmark, text, item, window, schema, work)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = 13, coverage: float = 0.5, length: str | None = None) -> DataFrame:
    """docs with the same columns: contaminated texts lose their hit spans, or go if these cover ``coverage`` of the words.

    Texts that are not contaminated stay as they are, null and empty texts too; repeated rows are treated
    each.  Columns may have any names.  Cutting may bring new windows of the same items together, so it
    is repeated until none is left (in a larger benchmark, of the items that the whole text met).  Where docs has a long column
    named ``length``, it gets the code points of each text that was cut.
    """
    at = docs.columns.index(text)
    counted = docs.columns.index(length) if length in docs.columns and docs.schema[length].dataType == T.LongType() else None
    names = docs.columns

    def work(b: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        keep, texts = [], []
        sizes = b.column(counted).to_pylist() if counted is not None else []
        for i, t in enumerate(as_bytes(b.column(at))):
            found = look(split_alnum(t or b""), block)
            if is_contaminated(int(found.hit.sum()), found.n_words):
                t = cleaned(t, block, coverage)
                keep.append(t is not None)
                if sizes and t is not None:
                    sizes[i] = len(t.decode("utf-8", "surrogatepass"))
            else:
                keep.append(True)
            texts.append(t)
        columns = list(b.columns)
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        if counted is not None:
            columns[counted] = pa.array(sizes, pa.int64())
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return _looked(docs, benchmark, text, item, window, docs.schema, work)
