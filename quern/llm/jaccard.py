"""Near-duplicate join on word shingles: T-occurrence search with DivideSkip.

Two texts link when 100 |A & B| >= 85 |A | B| of their shingle sets.  Linked texts share at
least T shingles, so a text's partners are those that occur on T or more of the inverted lists
of its shingles.  DivideSkip merges the short lists with a heap, asks each candidate for T - L
occurrences there, and probes the L long lists by binary search.  The same division
is made twice here, once across the cluster and once inside small blocks:

1.  Shingles are 64-bit hashes.  Texts with equal sets are one *node* (128-bit fingerprint); copies
    are never expanded.
2.  Shingles of the lower half of the hash range are counted over all texts, by keys whose bits grow with
    the number of texts.  The most frequent keys, as many as fit a fixed table, go to the tasks, which
    order shingles alike: rare ones first, then those of the table by their level, then those not
    counted, and by hash within each kind.  The table only serves the order: a list that is
    long though its key is in no table is found to be so in step 3.
3.  Each node posts the first part of its ordered set: with |x| - ceil(.85 |x|) + e of it, linked
    texts share at least e posted shingles (a little fewer for unlike sizes; the exact number
    is computed per pair).  Postings of rare shingles meet on their lists.  Pairs are counted on
    lists of at most SHORT_LIST postings only, so a posting makes a bounded number of pairs.  What a
    node posts on longer lists is counted as *often*, like its postings of the table's shingles; a pair
    stays if its count reaches what is needed less the often postings that the two may share.
4.  Two nodes that meet on no short list can be linked through long ones only, and then both have at least e
    often postings.  Such nodes join the least node of each of their long lists (lists that were not
    counted are taken as long): one edge a posting, however long the list.  Lists of the table's shingles
    are dealt over SALTS parts; the others have at most (postings / table size) members.
5.  Components of these candidate edges are *blocks*: a link never leaves its block.  Each set moves to its
    block once, and the block runs DivideSkip with union-find, leaving out pairs that are
    connected already.  A block of more than BLOCK_WEIGHT shingles is cut into chunks, each a task of its
    own: see ``_search``.

The result is exact up to collisions of 64-bit hashes.  No pair of a group of copies is ever
emitted, and no list, set or group is cut short.  What is not linear: texts made of nothing but common
shingles that are still not linked with each other may share a large block, and there those
outside the class of the least node meet all chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import as_bytes, only, slices, written
from quern.llm.components import components

#: Keys that more than SHORT texts hold are frequent; the most frequent of them, at most TABLE (9 bytes each), are sent to the tasks.
SHORT, TABLE = 12, 2_000_000
#: Pairs are made on lists of at most so many postings.
SHORT_LIST = 48
#: Share of the hash range whose shingles are counted; others come last in the order.
COUNTED = 0.5
#: Posted beyond the plain prefix, as a share of the set, and at least.
EXTRA, LEAST_EXTRA = 0.05, 3
#: Weight of one task's sets, in shingles (8 bytes each); a set weighs SET_WEIGHT besides its own. A single set may have more.
BLOCK_WEIGHT, SET_WEIGHT = 1_000_000, 400
#: Parts of a long list, or of a block with many nodes.
SALTS = 64
#: The filter that tells which texts are needed again has 64 bits a node or more, up to so many; where these are under eight a node, texts are joined by their keys.
FILTER_BITS = 1 << 28
#: Bytes of text that are hashed at once (some 30 bytes of memory each), and the words hashed one by one instead, from so many bytes.
PIECE, LONG_WORD = 1 << 18, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(9)).integers(0, 2**64, 256, np.uint64)  # by stated bit generator: alike on all machines
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
#: A base whose powers differ in low bits (3 modulo 8), its inverse modulo 2^64, and powers of both.
_BASE = 0x9E3779B97F4A7C1B
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift in (32, 29):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _powers_upto(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse; kept for the next piece."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    return _powers


def _piece_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, their places in text); text begins and ends with white space.

    A word's hash is a polynomial of its lower-cased bytes, taken as the difference of two sums from the start of
    the piece over the power at the word's first byte: it depends on the word alone.
    """
    raw = np.frombuffer(text, np.uint8)
    powers, inverses = _powers_upto(len(raw))
    white = _SPACE[raw]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    sums = _BYTE[raw]
    with np.errstate(over="ignore"):
        sums *= powers[: len(raw)]
        np.cumsum(sums, out=sums)
        h = _mixed((sums[ends - 1] - sums[starts - 1]) * inverses[starts])
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].lower())
    return h, starts


def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one text, in pieces that end at white space; a very long word costs no more than its bytes."""
    out, at = [], 0
    while at < len(text):
        cut = _WHITE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        if end - at <= PIECE + LONG_WORD:
            out.append(_piece_hashes(b" " + text[at:end] + b" ")[0])
        else:
            *words, last = text[at:end].split(None)
            out.append(_piece_hashes(b" " + b" ".join(words) + b" ")[0])
            out.append(np.array([xxhash.xxh64_intdigest(last.lower())], np.uint64) if len(last) >= LONG_WORD else _piece_hashes(b" " + last + b" ")[0])
        at = end
    return np.concatenate([*out, np.empty(0, np.uint64)])


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    acc = np.full(max(0, len(h) - k + 1), np.uint64((0x9E3779B97F4A7C15 + k) % 2**64), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(acc)]
    return _mixed(acc)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: list[bytes | None], size: int = 4) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word shingles; of all words as one, if they are fewer."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or b"") < PIECE):
            held += len(texts[end] or b"") + 1
            end += 1
        some = [t or b"" for t in texts[at:end]]
        if len(some) == 1:
            h, bounds = _word_hashes(some[0]), [0]
        else:
            h, starts = _piece_hashes(b" " + b" ".join(some) + b" ")
            firsts = np.cumsum([1, *(len(t) + 1 for t in some[:-1])])
            bounds = np.searchsorted(starts, firsts).tolist()
        windows = _windows(h, size)
        for a, z in zip(bounds, [*bounds[1:], len(h)], strict=True):
            yield _distinct(windows[a : z - size + 1] if z - a >= size else _windows(h[a:z], z - a) if z > a else h[:0])
        at = end


def shingle_set(text: bytes | None, size: int = 4) -> np.ndarray:
    return next(shingle_sets([text], size))


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _keys(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the counted shingles (a sorted run at the start), sorted: their 32 + bits upper bits below the first, which is 0."""
    n = np.searchsorted(shingles, np.uint64(int(COUNTED * 2**64)))
    return shingles[:n] >> np.uint64(31 - bits)


def need(a: int, b: int, percent: int = 85) -> int:
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def fits(a: int, b: int, percent: int = 85) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def linked(common: int, a: int, b: int, percent: int = 85) -> bool:
    return 100 * common >= percent * (a + b - common)


def extra(n):
    return np.maximum(LEAST_EXTRA, np.ceil(EXTRA * np.asarray(n)).astype(np.int64))


def posted(n, percent: int = 85):
    """How many of its n ordered shingles a node posts."""
    n = np.asarray(n, np.int64)
    return np.minimum(n, n + percent * n // -100 + extra(n))  # n - ceil(percent n / 100) + extra


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    offsets = np.cumsum([0, *map(len, arrays)])
    return np.concatenate([*arrays, np.empty(0, np.uint64)]), pa.array(offsets, pa.int32())


@dataclass(frozen=True)
class Frequent:
    """Sorted keys of 32 + bits bits and their levels, in quarters of a doubling."""

    bits: int
    keys: np.ndarray
    levels: np.ndarray


def _summed(counts: list[np.ndarray]) -> np.ndarray:
    """Counts of 32-bit keys, each key << 32 | count: one a key, sorted."""
    both = np.sort(np.concatenate(counts))
    keys = both >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    n = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) if len(keys) else both
    return keys[first] << np.uint64(32) | np.minimum(n, np.uint64(0xFFFFFFFF))


def add_counts(group: pa.Table) -> pa.Table:
    """Rows (chunk, keys, n) of one chunk -> its keys of more than SHORT texts.

    Rows are as many as the tasks found parts, so they are gathered and summed only when they outweigh the sums so far:
    each count is sorted a few times, however many rows there are, and memory stays in proportion to the distinct keys.
    """
    sums, held, size = np.empty(0, np.uint64), [], 0
    for k, c in zip(group.column("keys"), group.column("n"), strict=True):
        held.append(np.frombuffer(k.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(c.as_buffer(), np.uint8))
        size += len(held[-1])
        if size > max(1_000_000, len(sums)):
            sums, held, size = _summed([sums, *held]), [], 0
    sums = _summed([sums, *held])
    n = (sums & np.uint64(0xFFFFFFFF)).astype(np.int64)
    many = n > SHORT
    chunk = group.column("chunk")[0].as_py() if group.num_rows else 0
    return pa.table({"key": pa.array((sums[many] >> np.uint64(32)).astype(np.int64) + (chunk << 32)), "n": pa.array(n[many])})


def _frequent(docs: DataFrame, text: str) -> Frequent:
    """The keys that more than SHORT texts hold, the most frequent TABLE of them."""
    bits = min(20, max(6, (docs.count() // 4000).bit_length()))  # a key range of about a million keys for each value of the upper bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)  # of one task's two million; sums of tasks are not cut
            chunk = (keys >> np.uint64(32)).astype(np.int64)
            low = keys.astype(np.uint32)
            edges = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(keys))
            rows = [(chunk[a], low[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "keys", "n"])

        for b in slices(batches):
            for s in shingle_sets(as_bytes(b.column(0))):
                k = _keys(s, bits)
                held.append(k)
                size += len(k)
                if size > 2_000_000:
                    yield from out()
                    held, size = [], 0
        yield from out()

    counted = written(only(docs, text).mapInArrow(count, "chunk int, keys binary, n binary").groupBy("chunk").applyInArrow(add_counts, "key long, n long"), "frequent")
    at_least = {r["n"]: r["c"] for r in counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("c")).toLocalIterator()}
    level, total = SHORT + 1, sum(at_least.values())
    for n in sorted(at_least):
        if total <= TABLE:
            break
        total -= at_least[n]
        level = n + 1
    kept = counted.where(F.col("n") >= level).select("key", F.least(F.lit(254), F.floor(4 * F.log2("n"))).cast("int").alias("l")).toPandas()  # at most TABLE keys, whatever the input
    order = np.argsort(kept["key"].to_numpy(), kind="stable")
    return Frequent(bits, kept["key"].to_numpy()[order].astype(np.uint64), kept["l"].to_numpy()[order].astype(np.uint8))


def _ordered(shingles: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, int]:
    """(the posted shingles in order, how many of these, at the end, are in the table or not counted).

    The order: counted and rare, frequent by level, not counted; by hash within each.
    """
    often, level = frequent.keys, frequent.levels
    keys = _keys(shingles, frequent.bits)
    kind = np.full(len(shingles), 255, np.uint8)
    kind[: len(keys)] = 0
    if len(often):
        at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        kind[: len(keys)] = np.where(often[at] == keys, level[at], 0)
    n = int(posted(len(shingles)))
    rare = np.flatnonzero(kind == 0)
    if len(rare) >= n:
        return shingles[rare[:n]], 0
    return shingles[np.argsort(kind, kind="stable")[:n]], n - len(rare)


def sets(docs: DataFrame, frequent: Frequent, key: str, text: str) -> DataFrame:
    """key, n (set size), fp, posted shingles, n_often (how many of these, at the end, are in the table or not counted)."""
    slim = only(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for b in slices(batches):
            found = list(shingle_sets(as_bytes(b.column(1))))
            first = [_ordered(s, frequent) if len(s) else (s, 0) for s in found]
            flat, offsets = _flat([f[0] for f in first])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([fingerprint(s) for s in found], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))), pa.array([f[1] for f in first], pa.int64())], names=["key", "n", "fp", "posted", "n_often"])

    return slim.mapInArrow(run, T.StructType([T.StructField("key", slim.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("posted", T.ArrayType(T.LongType())), T.StructField("n_often", T.LongType())]))


def _meet(nodes: DataFrame, buckets: int) -> DataFrame:
    """Lists of shingles that are not in the table: pairs (a, b, c) that meet c times on short ones, and postings (list, node, 0) on longer ones.

    A posting is six bytes of the hash and the place of its node in the list beside it, so
    its size has a bound whatever the number of buckets.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, often = b.column(0).to_numpy(), b.column(2).to_numpy()
            lists = b.column(1)
            flat = lists.flatten().to_numpy().view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ids)), size)
            keep = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)) < np.repeat(size - often, size)
            flat, owner = flat[keep], owner[keep]
            # the order is by hash, so posted hashes are low: buckets are cut from the low bits
            bucket = ((flat & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, owner, bucket = flat[order], owner[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                a, z = edges[k], edges[k + 1]
                if z > a:
                    used, local = np.unique(owner[a:z], return_inverse=True)
                    six = flat[a:z].view(np.uint8).reshape(-1, 8)[:, 2:]
                    rows.append((k, six.tobytes(), local.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), ids[used].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "shingles", "owners", "nodes"])

    def meet(group: pa.Table) -> pa.Table:
        shingles, owners = [], []
        for s, o, i in zip(*(group.column(c).to_pylist() for c in ("shingles", "owners", "nodes")), strict=True):
            wide = np.zeros((len(s) // 6, 8), np.uint8)
            wide[:, 2:] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            shingles.append(wide.view(np.uint64).reshape(-1))
            owners.append(np.frombuffer(i, np.int64)[np.frombuffer(o, np.uint16 if len(o) * 3 == len(s) else np.uint32)])
        s, o = np.concatenate(shingles), np.concatenate(owners)
        order = np.argsort(s, kind="stable")
        s, o = s[order], o[order]
        edges = np.append(np.flatnonzero(np.diff(s, prepend=~s[:1])), len(s))
        long = np.repeat(np.diff(edges) > SHORT_LIST, np.diff(edges))
        listed, holders = s[long].view(np.int64), o[long]
        s, o = s[~long], o[~long]
        first, second = [], []
        # each posting meets those after it on its list: as many rounds as the longest short list has members
        step, alive = 1, np.arange(len(s))
        while True:
            alive = alive[alive + step < len(s)]
            alive = alive[s[alive] == s[alive + step]]
            if not len(alive):
                break
            x, y = o[alive], o[alive + step]
            first.append(np.minimum(x, y)[x != y])
            second.append(np.maximum(x, y)[x != y])
            step += 1
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (first, second))
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        c = np.diff(np.append(start, len(a))).astype(np.int64)
        return pa.table({"a": np.concatenate([a[start], listed]), "b": np.concatenate([b[start], holders]), "c": np.concatenate([c, np.zeros(len(listed), np.int64)])})

    return nodes.select("node", "posted", "n_often").mapInArrow(post, "bucket long, shingles binary, owners binary, nodes binary").groupBy("bucket").applyInArrow(meet, "a long, b long, c long")


def _extra(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_EXTRA), F.ceil(F.lit(EXTRA) * n))


def _short_list_pairs(met: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet on short lists, as often as is needed beside what they may share on longer ones; size: (node, n, often)."""
    both = met.where("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"))
    both = both.join(size.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("often").alias("oa")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("often").alias("ob")), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))

    def surplus(n: str):
        prefix = F.least(F.col(n), F.col(n) - F.ceil(percent * F.col(n) / F.lit(100)) + _extra(F.col(n)))
        return prefix - F.col(n) + least

    return both.where(F.col("c") >= F.least(surplus("na"), surplus("nb")) - F.least("oa", "ob")).select("a", "b")


def _long_list_edges(nodes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(node, least node of the list) on long lists, of nodes that these alone could link.

    Linked nodes share at least min(e, e') postings, and a partner has at least percent of the size: so
    a node with fewer often postings than the smallest partner's ``extra`` is linked through short lists.
    """
    smallest = F.ceil(percent * F.col("n") / F.lit(100))
    rich = nodes.where((F.col("often") > 0) & (F.col("often") >= F.least(smallest, _extra(smallest))))
    tail = F.explode(F.expr("slice(posted, size(posted) - cast(n_often as int) + 1, cast(n_often as int))"))
    found = met.where("c = 0").select(F.col("b").alias("node"), F.col("a").alias("s"))
    lists = rich.where("n_often > 0").select("node", tail.alias("s")).unionByName(found.join(rich.select("node"), "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    # a long list is dealt over SALTS parts: its nodes join the least of their part, and these the least of all
    part = lists.groupBy("s", "salt").agg(F.min("node").alias("m"))
    inside = lists.join(part, ["s", "salt"]).where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    across = part.join(part.groupBy("s").agg(F.min("m").alias("top")), "s").where("m <> top").select(F.col("m").alias("a"), F.col("top").alias("b"))
    return inside.unionByName(across).distinct()


def candidates(nodes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) whose components hold every link; their number is linear in the postings."""
    met = written(_meet(nodes, buckets), "met")
    more = met.where("c = 0").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("more"))
    nodes = nodes.join(more, "node", "left").withColumn("often", F.col("n_often") + F.coalesce("more", F.lit(0)))
    return _short_list_pairs(met, nodes.select("node", "n", "often"), percent).unionByName(_long_list_edges(nodes, met, percent))


class Block:
    """The sets of a block as inverted lists, and their T-occurrence search.

    Shingles are numbered; owners holds the lists one after the other, rows the numbers of each member. A shingle of
    one member alone has a list of no use, and most shingles are such: they are left out of rows.
    """

    def __init__(self, members: list[np.ndarray]) -> None:
        self.sizes = np.array([len(m) for m in members])
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        number = np.empty(len(tokens), np.int64)
        number[order] = np.cumsum(first) - 1
        self.owners = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.bounds = np.append(np.flatnonzero(first), len(tokens))
        length = np.diff(self.bounds)
        ends = np.cumsum(self.sizes)
        self.rows = []
        for e, n in zip(ends, self.sizes, strict=True):
            row = number[e - n : e]
            shared = length[row]
            row, shared = row[shared > 1], shared[shared > 1]
            self.rows.append(row[np.argsort(shared, kind="stable")])  # short lists first
        self.parent = list(range(len(members)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def _counts(self, lists: np.ndarray) -> np.ndarray:
        """How many of these lists hold each member."""
        at = zip(self.bounds[lists].tolist(), self.bounds[lists + 1].tolist(), strict=True)
        return np.bincount(np.concatenate([self.owners[a:z] for a, z in at]), minlength=len(self.sizes))

    def search(self, x: int, percent: int, mu: float = 0.02) -> None:
        """Joins x with every text linked to it that is not connected with it yet."""
        n, row = int(self.sizes[x]), self.rows[x]
        least = -(-percent * n // 100)  # a partner shares at least this many
        if len(row) < least:
            return
        longest = int(self.bounds[row[-1] + 1] - self.bounds[row[-1]])
        n_long = min(least - 1, int(least / (mu * np.log2(max(2, longest)) + 1)))
        short, long = row[: len(row) - n_long], row[len(row) - n_long :]
        if len(short) < least - n_long:
            return
        common = self._counts(short)
        sizes = self.sizes
        candidates = np.flatnonzero((common >= least - n_long) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
        mine = self.root(x)
        candidates = np.array([y for y in candidates.tolist() if y != x and self.root(y) != mine], np.int64)
        if not len(candidates):
            return
        common = common[candidates]
        if len(long):
            starts, stops = self.bounds[long], self.bounds[long + 1]
            if 16 * len(candidates) * len(long) < int((stops - starts).sum()):
                for a, z in zip(starts.tolist(), stops.tolist(), strict=True):  # few candidates: probe each long list
                    held = self.owners[a:z]
                    at = np.minimum(np.searchsorted(held, candidates), z - a - 1)
                    common = common + (held[at] == candidates)
            else:  # to probe for so many is dearer than to count
                common = common + self._counts(long)[candidates]
        other = sizes[candidates]
        for y in candidates[100 * common >= percent * (n + other - common)].tolist():
            self.join(x, y)

    def solve(self, percent: int, askers: list[bool] | None = None) -> list[int]:
        """The least member of each member's component; with askers, by the links of these alone.

        Once all but one component have been searched from every member, no link is left: a link between
        components has an end outside the largest.  The first member is searched first, which settles a group of copies of it.
        """
        if askers is not None and not all(askers):
            for x in np.flatnonzero(askers).tolist():
                self.search(x, percent)
            return [self.root(x) for x in range(len(self.sizes))]
        self.search(0, percent)
        big = self.root(0)
        for x in sorted(range(1, len(self.sizes)), key=lambda x: self.root(x) == big):
            if self.root(x) != big:
                self.search(x, percent)
        return [self.root(x) for x in range(len(self.sizes))]


def solve_groups(group: pa.Table, percent: int) -> pa.Table:
    """Rows (block, node, fp, set) of one task's blocks -> (node, root).  Sets of one node, of a key with several texts, are joined.

    With a column ``asks`` only links with an end among the rows that ask are looked for.
    """
    blocks: dict[int, dict[tuple[int, bytes], np.ndarray]] = {}
    for block, node, fp, raw in zip(*(group.column(c).to_pylist() for c in ("block", "node", "fp", "shingles")), strict=True):
        blocks.setdefault(block, {})[node, fp] = np.frombuffer(raw, np.uint64)
    asking = None
    if "asks" in group.column_names:
        named = zip(*(group.column(c).to_pylist() for c in ("block", "node", "fp", "asks")), strict=True)
        asking = {(block, node, fp) for block, node, fp, asks in named if asks}
    nodes, roots = [], []
    for name, members in blocks.items():
        ids = sorted(members)
        if len(ids) > 1:
            block = Block([members[i] for i in ids])
            for x in range(1, len(ids)):
                if ids[x][0] == ids[x - 1][0]:
                    block.join(x - 1, x)
            found = block.solve(percent, None if asking is None else [(name, *i) in asking for i in ids])
            nodes += [i[0] for i in ids]
            roots += [ids[r][0] for r in found]
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})


def _weight() -> Column:
    return F.sum(F.col("n") + SET_WEIGHT)


def _filter_of(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each node: bits / 8 bytes; others that pass are joined away."""
    at = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = nodes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {bits}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for b in words.toArrow().to_batches():  # at most bits / 64 rows
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def _candidate_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, fp, shingles, ...) of the wanted nodes' texts, which are read again.

    Where a filter of the wanted nodes is within FILTER_BITS, only what passes it leaves its place; beyond,
    texts are joined with the wanted nodes by key.  Either way the join by (node, fp) decides.
    """
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text")).where("node is not null")
    count = wanted.count()
    bits = max(64, min(FILTER_BITS, 1 << (64 * count).bit_length()))
    filtered = 8 * count <= FILTER_BITS
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, bits) if filtered else None)
    if not filtered:
        slim = slim.join(wanted.select("node"), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = shared.value
        for b in slices(batches):
            if passing is not None:
                at = b.column(2).to_numpy()
                b = b.filter(pa.array((passing[at >> 6] >> (at & 63)) & 1 == 1))
            found = list(shingle_sets(as_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "fp", "shingles"])

    return slim.withColumn("at", F.pmod(F.xxhash64("node"), F.lit(bits))).mapInArrow(run, "node long, fp binary, shingles binary").join(wanted, ["node", "fp"])


def _search(sets_of: Callable[[DataFrame], DataFrame], wanted: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(a, b): links that connect each linked class of nodes.

    wanted: (node, fp, n, block, chunks, chunk); sets_of gives such rows with their shingles.
    Small blocks are solved whole, many to a task.  A large block is solved in two steps.  First
    each of its chunks, together with the block's least node: in a group of near copies this
    connects nearly all with that node, wherever they are.  A link that is still missing has an
    end outside the class of the least node; these ends, chunk by chunk, then meet all chunks.
    """
    solve = lambda g: solve_groups(g, percent)
    large = F.col("chunks") > 1
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # the least node of a block is its name; a large block's goes to all its chunks
    at = F.explode(F.when(large & (F.col("node") == F.col("block")), upto(F.col("chunks"))).otherwise(F.array("chunk")))
    task = F.when(large, F.xxhash64("block", "at")).otherwise(F.pmod(F.xxhash64("block"), F.lit(tasks)))
    first = sets_of(wanted).withColumn("at", at).select(task.alias("task"), "block", "node", "fp", "shingles")
    step = written(first.groupBy("task").applyInArrow(solve, "node long, root long"), "links")
    links = step.select(F.col("node").alias("a"), F.col("root").alias("b"))
    big = wanted.where(large)
    if big.isEmpty():
        return links
    inside = components(links.join(big.select(F.col("node").alias("a")), "a", "left_semi"))
    placed = big.join(inside, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = placed.where("node = block").select("block", F.col("root").alias("main"))
    placed = placed.join(main, "block").withColumn("apart", F.col("root") != F.col("main"))
    rest = placed.where("apart").groupBy("block").agg(F.ceil(_weight() / BLOCK_WEIGHT).cast("long").alias("groups"))
    placed = written(placed.join(rest, "block"), "large-blocks")
    if placed.isEmpty():
        return links
    whole = sets_of(placed.select("node", "fp", "block", "chunk", "chunks", "apart", "groups"))
    group = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("groups"))
    # a node apart goes, with its group, to every chunk of its block; every node goes, with its chunk, to every group
    asked = F.when(F.col("apart"), F.transform(upto(F.col("chunks")), lambda j: F.struct(group.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    met = F.transform(upto(F.col("groups")), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j")))
    asks = F.col("apart") & (F.col("to.i") == group)
    both = whole.withColumn("to", F.explode(F.array_distinct(F.concat(asked, met)))).select(F.xxhash64("block", "to.i", "to.j").alias("task"), "block", "node", "fp", "shingles", asks.alias("asks"))
    last = written(both.groupBy("task").applyInArrow(solve, "node long, root long"), "links")
    return links.unionByName(last.select(F.col("node").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """key, ``n_shingles``, ``component_id`` (the smallest key reachable by links, its own included), one row per input row.

    Keys are whole numbers.  Null and empty texts have no shingles and link with nothing.  A null key
    has a null component and takes no part in links.  Rows that repeat a key are one vertex each, under
    that key.  Texts of any length are read whole; an empty table gives an empty result.
    """
    rows = written(sets(docs, _frequent(docs, text), key, text), "shingles")
    live = rows.where("key is not null and n > 0")
    nodes = written(live.groupBy("fp", "n", "n_often").agg(F.min(F.col("key").cast("long")).alias("node"), F.first("posted").alias("posted")), "nodes")
    volume = nodes.agg(F.sum(F.size("posted"))).first()[0] or 0
    blocks = components(candidates(nodes, percent, max(8, int(volume // 500_000))))
    placed = written(blocks.join(nodes.select("node", "fp", "n"), "node").select("node", "fp", "n", F.col("root").alias("block")), "blocks")
    wanted = written(_chunked(placed), "chunks")
    tasks = max(8, int((wanted.agg(_weight()).first()[0] or 0) // BLOCK_WEIGHT))
    links = _search(lambda some: _candidate_sets(docs, some, key, text), wanted, tasks, percent)
    linked_to = components(links)
    component = nodes.select("fp", "n", "node").join(linked_to, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("root"))
    # rows without shingles or key have no part in the join, so neither empty texts nor null keys are one hot key of it
    apart = rows.where("key is null or n = 0").select("key", "n", F.col("key").cast("long").alias("component_id"))
    out = live.select("key", "fp", "n").join(component, ["fp", "n"]).select("key", "n", F.col("root").alias("component_id")).unionByName(apart)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _chunked(placed: DataFrame) -> DataFrame:
    """With ``chunks`` (of the block) and ``chunk`` (of the node). Only large blocks are looked up, each in SALTS copies, so a large one is no hot key."""
    sizes = placed.groupBy("block").agg(F.ceil(_weight() / BLOCK_WEIGHT).cast("long").alias("chunks")).where("chunks > 1")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(salted, ["block", "salt"], "left")
    return found.drop("salt").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))).withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """docs with one row of each component, that of the smallest key; rows with null keys stay.

    Of rows that repeat such a key the one with the least text stays (null first), of equal texts the one
    with the least hash of the row.  Columns may have any names.
    """
    found = near_duplicates(docs, key, text, percent).select(F.col(f"`{key}`").alias("key"), "component_id")
    kept = found.where("key = component_id").select("key").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    named = row.join(kept, "key", "left_semi")
    if found.groupBy("key").agg(F.count("*").alias("c")).where("key is not null and c > 1").limit(1).count():
        named = named.groupBy("key").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    out = named.select("row").unionByName(row.where("key is null").select("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
