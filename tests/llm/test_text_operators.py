import random

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, features, licenses, rules

from . import fixtures as fx
from .fixtures import SCHEMA, documents, frame, odd


def items(rows, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(25):
        w = (rng.choice(rows)[1] or "x").split()[:4000] or ["x"]
        a = rng.randrange(len(w))
        out.append((i, " ".join(w[a : a + rng.choice((1, 2, 5, 12, 13, 14, 30))]) + "!"))
    return [*out, (30, None), (31, " .. "), (32, out[3][1]), (33, "no such words here at all")]


def test_decontamination(spark):
    rows = documents()
    bench = items(rows)
    got = decontaminate.measure(odd(frame(spark, rows)), spark.createDataFrame(bench, "item_id long, text string"))
    want = fx.decontamination(rows, [(i, t) for i, t in bench if t])
    assert {r["doc_id"]: tuple(r)[1:6] for r in got.collect()} == want


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_decontamination_by_a_large_benchmark(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BENCHMARK_WORDS", 20)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    rows = documents()
    bench = items(rows, 2)
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.measure(odd(frame(spark, rows)), table)
    assert {r["doc_id"]: tuple(r)[1:6] for r in got.collect()} == fx.decontamination(rows, [(i, t) for i, t in bench if t])
    docs = odd(frame(spark, rows)).withColumn("a.b", F.lit(1))
    large = decontaminate.clean(docs, table, length="n_chars")
    monkeypatch.setattr(decontaminate, "BENCHMARK_WORDS", 10**6)
    small = decontaminate.clean(docs, table, length="n_chars")
    assert large.columns == small.columns == docs.columns
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_decontamination_of_awkward_rows(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(700_000))
    item = " ".join(f"w{k}" for k in range(400_000, 400_013))
    rows = [(1, long, None, None, 1), (None, item, None, None, 1), (None, item, None, None, 1), (2, item, None, None, 1), (2, item, None, None, 1), (3, None, None, None, None), (4, "", None, None, None)]
    bench = spark.createDataFrame([(7, item), (None, item), (7, "w5")], "item_id long, text string")
    for words in (10**6, 1):
        monkeypatch.setattr(decontaminate, "BENCHMARK_WORDS", words)
        got = sorted(map(str, (tuple(r)[:4] for r in decontaminate.measure(frame(spark, rows), bench).collect())))
        assert got == sorted(map(str, [(1, 700_000, 14, 2), (None, 13, 13, 2), (None, 13, 13, 2), (2, 13, 13, 2), (2, 13, 13, 2), (3, 0, 0, 0), (4, 0, 0, 0)]))


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    """Few letters, so windows repeat, overlap and nest."""
    rng = random.Random(seed)
    bench = [(str(i), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30)))) for i in range(4)]
    text = "".join(rng.choice("ab ") for _ in range(80))
    found = decontaminate.look(decontaminate.split_alnum(text.encode()), decontaminate.build([(i, t.encode()) for i, t in bench], 4))
    want = fx.decontamination([(0, text)], bench, 4)[0]
    assert (found.n_words, int(found.hit.sum()), len(found.items)) == want[:3]


def test_cleaning(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    clean = "nothing of the kind is in this text " * 4
    rows = [(1, clean + passage + ". " + clean, "en", "s", 0), (2, passage + " and little else", "en", "s", 0), (3, clean, "en", "s", 7), (4, None, "en", "s", 7), (5, clean * 30 + passage, "en", "s", 7)]
    out = decontaminate.clean(frame(spark, rows), spark.createDataFrame([(1, passage)], "item_id long, text string"), length="n_chars")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert set(got) == {1, 3, 4, 5}
    assert got[1]["text"] == clean + "\n. " + clean
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == clean and got[4]["text"] is None and got[5]["text"] == clean * 30 + passage


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = frame(spark, documents()[:3])
    assert decontaminate.measure(none, bench).count() == 0
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontaminate.measure(some, bench).collect())
    assert rules.judge(none, labels).count() == 0
    assert licenses.summarise(*licenses.scan(none)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(("a", "b", "ab ", " ", "\n", "é", "#", "|", "\t", "\x0b", "\x85", " ", "a b a\n")) for _ in range(rng.randint(0, 120)))
    assert tuple(features.counts(text.encode())[:5]) == fx.counts(text)


def test_rules(spark):
    rows = documents()
    rng = random.Random(0)
    bad = [(200 + k, " ".join(w.upper() + "!!" for w in fx.prose(rng, 80).split()), "en", "s", 0) for k in range(40)]
    good = [(300 + k, fx.prose(rng, 80), "en", "s", 0) for k in range(40)]
    labels = spark.createDataFrame([(r[0], int(r[0] >= 300)) for r in bad + good] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.judge(odd(frame(spark, rows + bad + good + [(None, "x", None, None, None)])), labels).collect()}
    for i, t, *_ in rows:
        n_words, *_, repeated = want = fx.counts(t)
        assert tuple(got[i][c] for c in features.BASE) == want
        assert got[i]["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert not any(got[r[0]]["kept"] for r in bad)
    assert all(got[r[0]]["kept"] != got[r[0]]["base_failed"] for r in good)
    assert all(">=" in got[r[0]]["rule"] or "<" in got[r[0]]["rule"] for r in bad)
    assert None in got


def test_licenses(spark):
    rows = [*documents(), (500, "Released under the MIT License " * 3, "en", "s", 0), (501, "all rights reserved all rights reserved", "en", "s", 0), (502, "Licensed under the new Apache License, Version 2.0", "en", "s", 0), (503, "License under permission granted to any person", "en", "s", 0), (None, "gnu general public license", "en", "s", 0)]
    got = {r["doc_id"]: r for r in licenses.summarise(*licenses.scan(odd(frame(spark, rows)))).collect()}
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == fx.licenses(t)
    assert got[500]["labels"] == "mit,mit-release" and got[500]["n_base"] == 3
    assert got[501]["labels"] == "all-rights-reserved"
    assert got[502]["labels"] == "apache,apache-2.0" and 0.6 <= got[502]["score"] <= 1
    assert got[503]["labels"] == "" and got[503]["score"] == 0
    assert got[None]["labels"] == "gpl"


def test_repeated_openings_are_no_notice_and_hide_none(spark):
    rows = [(1, "Licensed under CC licensed under CC and nothing more", "en", "s", 0), (2, "Licensed under the " * 4 + "Apache License, Version 2.0", "en", "s", 0), (3, "2.0 Version License Apache the under Licensed", "en", "s", 0)]
    rows += [(9, rows[1][1], "en", "s", 0)] * 2
    got = [(r["doc_id"], r["labels"], r["score"]) for r in licenses.summarise(*licenses.scan(frame(spark, rows))).orderBy("doc_id").collect()]
    assert got == [(1, "", 0.0), (2, "apache,apache-2.0", 1.0), (3, "", 0.0), (9, "apache,apache-2.0", 1.0), (9, "apache,apache-2.0", 1.0)]


def test_notices_against_a_plain_aligner(spark):
    rng = random.Random(8)
    notices = [(t.label, t.text) for t in licenses.NOTICES]
    rows = []
    for i in range(500):
        parts = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(notices)[1].split()
            a = rng.randrange(len(w))
            part = w[a : a + rng.randint(1, len(w))] if rng.random() < 0.5 else list(w)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(part) + 1)
                part = part[:k] + ["new"] * rng.randint(0, 3) + part[k + rng.randint(0, 2) :]
            parts += part * rng.choice((1, 1, 1, 3))
        rows.append((i, " ".join(parts), "en", "s", 0))
    rows.append((900, "Licensed under the " * 20_000 + notices[2][1], "en", "s", 0))  # a long one
    rows_of, spans = licenses.scan(frame(spark, rows))
    got = {r["doc_id"]: r for r in licenses.summarise(rows_of, spans).collect()}
    found = 0
    for i, t, *_ in rows[:-1]:
        want = fx.notice_labels(t, notices)
        base = fx.licenses(t)
        labels = sorted({*want, *filter(None, base[4].split(","))})
        assert got[i]["labels"] == ",".join(labels), t
        assert got[i]["score"] == pytest.approx(max([*want.values(), *([1.0] if base[1] else [])], default=0.0))
        found += bool(want)
    assert 100 < found < 500
    assert got[900]["labels"] == "apache,apache-2.0"
    by: dict = {}
    for r in spans.where("not exact").collect():
        by.setdefault((r["row_id"], r["template"]), []).append((r["first"], r["last"]))
    for x in by.values():  # spans of one notice do not overlap
        assert all(a[1] < b[0] for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
