import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard
from quern.llm.components import components

from .fixtures import SCHEMA, documents, frame, jaccard as brute, odd, prose


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_same_as_all_pairs(spark):
    rows = documents()
    assert result(jaccard.near_duplicates(odd(frame(spark, rows)))) == brute(rows)


@pytest.mark.parametrize(("block", "table", "bits"), [(200, 2_000_000, 1 << 28), (400_000, 2_000_000, 0), (200, 0, 1 << 28), (400_000, 5, 1 << 28)])
def test_groups_and_shared_passages(spark, monkeypatch, block, table, bits):
    """A large group of near copies, passages that many texts share, chains of edits; also with blocks cut into chunks, a full table, no filter."""
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", block)
    monkeypatch.setattr(jaccard, "SET_WEIGHT", 1)
    monkeypatch.setattr(jaccard, "TABLE", table)
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 6)
    rng = random.Random(8)
    passage = prose(rng, 30)
    texts = [prose(rng, 40) + " " + passage for _ in range(25)] + [passage + " " + passage + f" end{k}" for k in range(8)]
    chain = prose(rng, 60).split()
    for k in range(15):
        chain[4 * k] = f"step{k}"
        texts.append(" ".join(chain))
    base = prose(rng, 80).split()
    for _ in range(20):
        w = list(base)
        for j in rng.sample(range(80), rng.randint(0, 3)):
            w[j] = f"e{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert result(jaccard.near_duplicates(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (2, "A B C D E", None, None, None), (9, None, None, None, None), (8, "", None, None, None), (2, "A B C D E", None, None, None), (7, "x", None, None, None), (6, "X", None, None, None)]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 2), (2, 2, 2), (2, 2, 2), (9, 0, 9), (8, 0, 8), (7, 1, 6), (6, 1, 6)], key=str)


def test_keep_one(spark):
    rows = documents()
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    kept = jaccard.keep_one(frame(spark, [*rows, rows[0], (None, "z", None, None, None)]))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1


def test_prefixes_share_what_they_must():
    """Linked sets meet in at least as many posted shingles as a pair is asked for."""
    rng = np.random.default_rng(2)
    frequent = jaccard.Frequent(6, np.empty(0, np.uint64), np.empty(0, np.uint8))
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2)
        drop = rng.random(len(a)) < 0.08
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64) * 2 + 1]))
        c = len(np.intersect1d(a, b))
        if len(b) and jaccard.linked(c, len(a), len(b)):
            pa, na = jaccard._ordered(a, frequent)
            pb, nb = jaccard._ordered(b, frequent)
            need = jaccard.need(len(a), len(b))
            least = min(len(pa) - len(a) + need, len(pb) - len(b) + need)
            assert least >= 1
            assert len(np.intersect1d(pa, pb)) >= least
            assert len(np.intersect1d(pa[: len(pa) - na], pb[: len(pb) - nb])) >= least - min(na, nb)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0


def test_a_key_with_two_texts_keeps_both():
    import pyarrow as pa

    sets = [np.arange(a, a + 40, dtype=np.uint64) for a in (0, 1, 500, 501)]
    rows = [(1, 1, sets[0]), (1, 1, sets[2]), (1, 2, sets[1]), (1, 3, sets[3])]
    for order in (rows, rows[::-1]):
        group = pa.table({"block": [r[0] for r in order], "node": [r[1] for r in order], "fp": [jaccard.fingerprint(r[2]) for r in order], "shingles": [r[2].tobytes() for r in order]})
        got = jaccard.solve_groups(group, 85)
        assert set(zip(got.column("node").to_pylist(), got.column("root").to_pylist(), strict=True)) == {(1, 1), (2, 1), (3, 1)}


def test_candidate_sets_of_an_int_key(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(6)], "doc_id int, text string")
    wanted = spark.createDataFrame([(i, bytearray(jaccard.fingerprint(jaccard.shingle_set(f"a b c d e f{i}".encode()))), 0, 1, 0) for i in range(6)], "node long, fp binary, block long, chunks long, chunk long")
    assert jaccard._candidate_sets(docs, wanted, "doc_id", "text").count() == 6


@pytest.mark.parametrize("table", [0, 2_000_000])
def test_a_long_list_makes_few_candidates(spark, monkeypatch, table):
    """20,000 unlinked texts on one list: not a pair for every two of them, whether or not the list is in the table."""
    monkeypatch.setattr(jaccard, "TABLE", table)
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same words "), *(F.concat(F.lit(f" w{k}_"), F.col("id")) for k in range(8))).alias("text"))
    rows = jaccard.sets(texts, jaccard._frequent(texts, "text"), "doc_id", "text").withColumnRenamed("key", "node").cache()
    assert jaccard._meet(rows, 8).count() <= rows.select(F.sum(F.size("posted"))).first()[0]
    assert jaccard.candidates(rows, 85, 8).count() < 20_000
    rows.unpersist()


def test_awkward_rows_and_names(spark):
    rng = random.Random(2)
    long = prose(rng, 1000)
    long = " ".join([long] + [f"u{k}" for k in range(600_000)])  # about 5 MB
    rows = [(1, long), (2, long + " end"), (3, "p q r s t u v w"), (3, "some other words of this key"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "component_id": F.lit("x"), "fp": F.lit("y"), "key": F.lit(2), "row": F.lit(3)})
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, long), (3, "p q r s t u v w"), (None, None), (5, "")], key=str)


def test_counts_of_many_parts_are_sorted_a_few_times(monkeypatch):
    """A chunk of the counts comes in as many parts as there are millions of shingles: not a pass over all keys for each."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 300_000, 2000).astype(np.uint32)) for _ in range(1500)]
    counts = [rng.integers(1, 256, len(p)).astype(np.uint8) for p in parts]
    summed, sizes = jaccard._summed, []
    monkeypatch.setattr(jaccard, "_summed", lambda x: sizes.append(sum(map(len, x))) or summed(x))
    got = jaccard.add_counts(pa.table({"chunk": pa.array([3] * 1500, pa.int32()), "keys": [p.tobytes() for p in parts], "n": [c.tobytes() for c in counts]}))
    want = np.bincount(np.concatenate(parts), np.concatenate(counts)).astype(np.int64)
    keys = np.flatnonzero(want > jaccard.SHORT)
    assert got.column("key").to_pylist() == (keys + (3 << 32)).tolist()
    assert got.column("n").to_pylist() == want[keys].tolist()
    assert sum(sizes) < 2 * sum(map(len, parts))


def test_search_of_a_family_by_its_askers_alone(monkeypatch):
    """Edited copies of one text, linked and unlinked: as all pairs say; where some ask, only these are searched."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for share in rng.choice([0.02, 0.07, 0.1, 0.2], 90):
        s = base.copy()
        at = rng.random(len(s)) < share
        s[at] = rng.integers(0, 2**63, at.sum()).astype(np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(rng.integers(0, 50, rng.integers(1, 12)).astype(np.uint64)) for _ in range(60)]
    sets = list({s.tobytes(): s for s in sets}.values())
    asks = (rng.random(len(sets)) < 0.3).tolist()
    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if jaccard.linked(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y]))]

    def classes(pairs):
        block = jaccard.Block(sets)
        for x, y in pairs:
            block.join(x, y)
        return [block.root(x) for x in range(len(sets))]

    assert jaccard.Block(sets).solve(85) == classes(pairs)
    searched, search = [], jaccard.Block.search
    monkeypatch.setattr(jaccard.Block, "search", lambda self, x, *a: searched.append(x) or search(self, x, *a))
    group = pa.table({"block": [1] * len(sets), "node": list(range(len(sets))), "fp": [jaccard.fingerprint(s) for s in sets], "shingles": [s.tobytes() for s in sets], "asks": asks})
    got = jaccard.solve_groups(group, 85)
    assert dict(zip(got.column("node").to_pylist(), got.column("root").to_pylist(), strict=True)) == dict(enumerate(classes([p for p in pairs if asks[p[0]] or asks[p[1]]])))
    assert searched == [x for x in range(len(sets)) if asks[x]]


def test_sets_of_many_texts_at_once_are_those_of_each():
    texts = [b"", None, b" ", b"a", b"A b", b"\t\nx y Z w v\x0b\x0c\r", b"x" * 70_000 + b" y", "é ß Ä  q é ß Ä".encode(), b"\x1c a\x85b c d e", b"q " * 3 + b"Z" * 600_000 + b" tail one two", b"the same " * 90_000, b" ".join(b"u%d" % i for i in range(90_000))]
    for some in (texts, texts[::-1], texts * 2):
        for t, s in zip(some, jaccard.shingle_sets(some), strict=True):
            words = [bytes(w) for w in (t or b"").lower().split()]
            assert len(s) == len({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else [])
            assert (s == jaccard.shingle_set(t)).all()
            assert (s == jaccard.shingle_set(b"\r\n" + b"\t ".join(w.upper() for w in words))).all()
