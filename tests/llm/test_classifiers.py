import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from quern.llm.common import in_training_fold

from .fixtures import SCHEMA, documents, frame, odd, prose


def distance(a, b):
    """Edits with swaps of neighbours, plainly."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("seed", range(5))
def test_automata(seed):
    rng = random.Random(seed)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(8)]
    m = toxicity.Matcher(terms)
    for _ in range(400):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 2)] = rng.choice(("", "a", "b", "z", "ca"))
        w = "".join(w)
        assert set(m.find(w)) == {t for t in terms if w and distance(w, t) <= toxicity.edits_allowed(t)} if w else True


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(("idiot", "worthless", "disgusting", "scumbag"), 2):
                words.insert(rng.randrange(len(words)), w)
        junk = i % 7 == 0
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    more = [(9001, "you are an idoit and worthles, disgustng", "en", "s", 0), (9002, "", "en", "s", 0), (9003, None, "en", "s", 0), (None, "x", None, None, None)]
    got = {r["doc_id"]: r for r in toxicity.classify(odd(frame(spark, rows + more)), table).collect()}
    out = {r["doc_id"] for r in spark.range(600).withColumnRenamed("id", "doc_id").where(~in_training_fold("doc_id")).collect()}
    right = [got[i]["predicted"] == t for i, _, t in labels if i in out]
    assert len(right) > 80
    assert np.mean(right) >= 0.98
    assert got[9001]["predicted"] == 1  # misspelled
    assert got[9002]["predicted"] == 0 and got[9003]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got) == len(rows) + len(more)


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": (4.0, 3.0)}))
    direct, quoted, reported = (reader.features(t) for t in ("you are an idiot friend", 'he shouted "such an idiot" again', "the word idiot is old"))
    assert direct[1] > 0 and direct[4] == 0
    assert quoted[1] == 0 and quoted[4] > 0
    assert reported[1] == 0 and reported[4] > 0


def test_disguises():
    lexicon = toxicity.Lexicon({"idiot": (4.0, 3.0), "worthless": (4.0, 3.0)}, {}, frozenset({"idiom"}))
    for word in ("1d10t", "idi0t", "idiooooot", "id!ot", "w0rthle$$", "wrthles"):
        assert lexicon.look_up(word)[0] == "near", word
    for word in ("idiom", "1234567", "radio", ""):
        assert lexicon.look_up(word) is None, word


def test_quality_held_out(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(odd(frame(spark, [*rows, (9002, "", "en", "s", 0), (9003, None, "en", "s", 0), (None, "x", None, None, None)])), table).collect()}
    out = {r["doc_id"] for r in spark.range(600).withColumnRenamed("id", "doc_id").where(~in_training_fold("doc_id")).collect()}
    assert np.mean([got[i]["predicted"] == q for i, q, _ in labels if i in out]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got) == len(rows) + 3


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(2, 200)
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = table.withColumns({c: F.when(in_training_fold("doc_id"), F.col(c)).otherwise(1 - F.col(c)) for c in ("quality", "toxic")})
    for op in (quality.classify, toxicity.classify):
        assert sorted(map(tuple, op(docs, table).collect())) == sorted(map(tuple, op(docs, flipped).collect()))


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs, none = frame(spark, documents()), spark.createDataFrame([], SCHEMA)
    for op in (quality.classify, toxicity.classify):
        assert op(docs, labels).count() == len(documents())
        assert op(none, labels).count() == 0


def plain_risk(w, p, u, prior):
    """(R, inner part) of the squared loss, row by row."""
    loss = lambda x, sign: sum((1 - sign * (r @ w)) ** 2 / 4 for r in x) / len(x)
    inner = loss(u, -1) - prior * loss(p, -1)
    return prior * loss(p, 1) + max(0.0, inner), inner


@pytest.mark.parametrize("seed", range(6))
def test_minimiser_against_plain_descent(seed):
    """No small move in any direction lowers the risk that a plain sum over rows gives, where the inner part is positive."""
    rng = np.random.default_rng(seed)
    p = (rng.random((60, 5)) < 0.5).astype(float)
    u = np.vstack([p[rng.integers(0, 60, 90)], (rng.random((60, 5)) < 0.25).astype(float)])
    p[:, 0] = u[:, 0] = 1
    w = quality.minimise(p.mean(0), p.T @ p / len(p), u.mean(0), u.T @ u / len(u), 0.5, ridge=1e-9)
    best, inner = plain_risk(w, p, u, 0.5)
    assert inner > 0
    for _ in range(200):
        assert plain_risk(w + rng.normal(0, 0.05, 5), p, u, 0.5)[0] >= best - 1e-9


def test_the_risk_is_not_negative():
    """Where the linear system would drive the inner risk below zero, the point taken has none below zero and a lower risk than no model."""
    rng = np.random.default_rng(0)
    p = (rng.random((6, 12)) < 0.4).astype(float)
    u = (rng.random((40, 12)) < 0.3).astype(float)
    p[:, 0] = u[:, 0] = 1
    moments = p.mean(0), p.T @ p / 6, u.mean(0), u.T @ u / 40
    free = np.linalg.solve(moments[3] + 2e-4 * np.eye(12), 2 * 0.9 * moments[0] - moments[2])
    w = quality.minimise(*moments, 0.9)
    assert np.isfinite(w).all()
    assert plain_risk(free, p, u, 0.9)[1] < 0
    assert plain_risk(w, p, u, 0.9)[1] >= -1e-9
    assert plain_risk(w, p, u, 0.9)[0] < plain_risk(np.zeros(12), p, u, 0.9)[0]


def test_moments_and_scores_against_plain_sums(spark):
    rows, labels = corpus(5, 120)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = {i: quality.counts(t.encode()) for i, t, *_ in rows}
    x = quality.phi({c: np.array([counts[i][k] for i, *_ in rows]) for k, c in enumerate(quality.COUNTS)})
    learn = {r["doc_id"] for r in spark.range(120).withColumnRenamed("id", "doc_id").where(in_training_fold("doc_id")).collect()}
    good = np.array([q == 1 and i in learn for i, q, _ in labels])
    p = x[good]
    stats = quality.text_counts(frame(spark, rows), "doc_id", "text")
    n_p, sum_p, n_u, sum_u = quality._moments(stats.withColumn("g", F.col("doc_id").isin([i for (i, *_), g in zip(labels, good, strict=True) if g])), quality.COUNTS, "g")
    assert (n_p, n_u) == (len(p), len(x))
    assert np.array_equal(sum_p, sum(np.outer(r, r) for r in p)) and np.array_equal(sum_u, sum(np.outer(r, r) for r in x))
    prior = quality.class_prior(len(p), sum_p / len(p), len(x), sum_u / len(x))
    w = quality.minimise(sum_p[0] / len(p), sum_p / len(p), sum_u[0] / len(x), sum_u / len(x), prior, ridge=1 / len(p))
    want = {i: min(1.0, max(0.0, (r @ w + 1) / 2)) for (i, *_), r in zip(rows, x, strict=True)}
    got = {r["doc_id"]: r["score"] for r in quality.classify(frame(spark, rows), table).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior(share):
    """Bad texts stay out of some interval, so the least ratio is the share of good ones."""
    rng = np.random.default_rng(int(10 * share))
    one_hot = lambda n, weights: np.eye(len(weights))[rng.choice(len(weights), n, p=weights)]
    draw = lambda n, good: np.hstack([np.ones((n, 1)), one_hot(n, [0.6, 0.3, 0.1] if good else [0.0, 0.3, 0.7]), one_hot(n, [0.5, 0.5])])
    p, u = draw(3000, True), np.vstack([draw(int(8000 * share), True), draw(8000 - int(8000 * share), False)])
    assert abs(quality.class_prior(len(p), p.T @ p / len(p), len(u), u.T @ u / len(u)) - share) < 0.05


def test_words_of_a_chosen_stem_stay_terms():
    toxic = [toxicity.terms_of({"idiot"})] * 100 + [toxicity.terms_of({"idiots"})] * 10 + [toxicity.terms_of({"idiotic"})] * 10
    chosen = toxicity.choose(toxic, {}, 500)
    assert any(t[-1] == "*" and "idiot".startswith(t[:-1]) for t in chosen)
    lexicon = toxicity.Lexicon({t: (w, w) for t, w in chosen.items() if t[-1] != "*"}, {t[:-1]: w for t, w in chosen.items() if t[-1] == "*"})
    assert {"idiot", "idiots", "idiotic"} <= lexicon.words.keys()
    for w in ("diiot", "1d10t", "ldiot", "diiots"):
        assert lexicon.look_up(w)[0] == "near", w


def plain_choice(toxic, clean_df, n_clean, explained_by=8, least=3):
    """The greedy cover as its docstring says, looking at every term again in each round."""
    df = {t: sum(t in x for x in toxic) for t in set().union(*toxic)}
    odds = {t: float(np.log(((c + 0.5) / (len(toxic) + 1)) / ((clean_df.get(t, 0) + 0.5) / (n_clean + 1)))) for t, c in df.items()}
    good = {t for t, c in df.items() if c >= least and odds[t] >= 2.5 and clean_df.get(t, 0) <= 0.1 * c}
    taken, times, gone = [], [0] * len(toxic), set()
    while True:
        cover = {t: sum(t in x and n < explained_by for x, n in zip(toxic, times, strict=True)) for t in good - gone}
        rank = sorted((-c * (1.02 if t[-1] != "*" else 1), -odds[t], -len(t), t) for t, c in cover.items() if c >= least)
        if not rank:
            break
        t = rank[0][-1]
        taken.append(t)
        gone |= {t} | {u for u in good if t[-1] == "*" and u != t and u.startswith(t[:-1])}
        times = [n + (t in x and n < explained_by) for x, n in zip(toxic, times, strict=True)]
    words = {u for u in good for t in taken if t[-1] == "*" and u[-1] != "*" and u.startswith(t[:-1])}
    return {t: min(6.0, odds[t]) for t in {*taken, *words}}


@pytest.mark.parametrize("seed", range(12))
def test_choice_is_the_plain_greedy_cover(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(25)]
    toxic = [toxicity.terms_of(set(rng.sample(words, rng.randint(0, 12)))) for _ in range(40)]
    clean = {t: rng.randint(0, 3) for t in rng.sample(sorted(set().union(*toxic)), 10)}
    got = toxicity.choose(toxic, clean, 4000, explained_by=3)
    assert got == pytest.approx(plain_choice(toxic, clean, 4000, explained_by=3))


def test_repeated_documents_and_long_texts(spark):
    rows, labels = corpus(4, 150)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    long = " ".join(prose(random.Random(1), 40) for _ in range(9000))  # megabytes
    more = [(7000, long, "en", "s", 0), (7001, long + " you idiot, worthless scumbag, disgusting", "en", "s", 0)]
    once = frame(spark, rows + more).withColumn("a.b", F.lit(1))
    thrice = once.unionByName(once).unionByName(once)
    for op in (quality.classify, toxicity.classify):
        a, b = ({(r["doc_id"], round(r["score"], 9)) for r in op(x, table).collect()} for x in (once, thrice))
        if op is toxicity.classify:
            assert a == b  # the sample has a key once
        assert len(a) == len(b) == len(rows) + 2
        assert op(thrice, table).count() == 3 * (len(rows) + 2)
    kept = toxicity.keep_clean(thrice, table)
    assert kept.columns == thrice.columns
    assert kept.where("doc_id = 7000").count() == 3
    assert quality.keep_good(thrice, table).columns == thrice.columns
