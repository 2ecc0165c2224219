"""Quality rules as learned decision lists, by sequential covering.

From labelled statistics the learner grows one rule after another for bad texts: a
conjunction of threshold tests, each test chosen for its information gain on a growing
set, then pruned from its end on a pruning set (by precision there), and kept while it
is right more often than not.  Texts that a rule covers leave the sets, and the next rule
is grown for the rest.  The result is an ordered list: the first rule that holds decides.
It is given as Spark conditional expressions (``F.when(...).when(...)``), so applying it
needs no Python, and as text that people can read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import in_training_fold, only, written
from quern.llm.features import BASE, COUNTS, text_counts

#: Ratios that rules test, as (name, numerator, denominator); a denominator of 0 counts as 1.
RATIOS = (
    ("upper_share", "n_upper", "n_letters"), ("symbol_share", "n_symbols", "n_chars"), ("mark_share", "n_marks", "n_chars"), ("pipes_per_word", "n_pipes", "n_words"),
    ("bangs_per_word", "n_bangs", "n_words"), ("digit_share", "n_digits", "n_chars"), ("repeat_share", "n_repeat_words", "n_words"), ("twin_share", "n_twin_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"), ("distinct_share", "n_distinct", "n_words"), ("mean_word", "word_chars", "n_words"), ("words", "n_words", None),
)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] < self.threshold

    def column(self) -> Column:
        return ratio(self.name) >= self.threshold if self.above else ratio(self.name) < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float

    def holds(self, table: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for t in self.tests:
            out &= t.holds(table)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def ratio(name: str) -> Column:
    _, a, b = next(r for r in RATIOS if r[0] == name)
    over = F.col("n_upper") + F.col("n_lower") if b == "n_letters" else F.col(b) if b else F.lit(1)
    return F.col(a).cast("double") / F.greatest(over, F.lit(1)).cast("double")


def ratios(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    counts = counts | {"n_letters": counts["n_upper"] + counts["n_lower"]}
    return {name: counts[a].astype(float) / (np.maximum(counts[b], 1) if b else 1.0) for name, a, b in RATIOS}


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Test | None:
    """By the gain p1 * (log2(p1 / n1) - log2(p0 / n0)) of keeping only the rows where the test holds."""
    p0, n0 = bad[rows].sum(), len(rows)
    base, best, found = np.log2(p0 / n0), 1e-9, None
    for name, _, _ in RATIOS:
        v = table[name][rows]
        order = np.argsort(v, kind="stable")
        s, b = v[order], bad[rows][order].astype(float)
        cuts = np.flatnonzero(s[1:] > s[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(b)[cuts - 1]
        for above, p1, n1 in ((False, below, cuts), (True, p0 - below, n0 - cuts)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p1 > 0, p1 * (np.log2(p1 / n1) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                # half-way, rounded to four digits where that still separates
                cut = float((s[cuts[k] - 1] + s[cuts[k]]) / 2)
                short = float(f"{cut:.4g}")
                best, found = gain[k], Test(name, above, short if s[cuts[k] - 1] < short <= s[cuts[k]] else cut)
    return found


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1, most_rules: int = 20, most_tests: int = 5, least_precision: float = 0.7, least_cover: int = 4) -> list[Rule]:
    """Sequential covering; two thirds of the rows grow rules, one third prunes them."""
    n = len(bad)
    grow_side = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = np.flatnonzero(left & grow_side), np.flatnonzero(left & ~grow_side)
        if not bad[grow].any():
            break
        tests: list[Test] = []
        rows = grow
        while len(tests) < most_tests and not bad[rows].all():
            t = _best_test(table, bad, rows)
            if t is None:
                break
            tests.append(t)
            rows = rows[t.holds(table)[rows]]
        if not tests:
            break

        def worth(k: int) -> tuple[float, int]:
            held = np.ones(n, bool)
            for t in tests[:k]:
                held &= t.holds(table)
            p, m = bad[prune][held[prune]].sum(), held[prune].sum()
            return ((p + 1) / (m + 2), -k)

        tests = tests[: max(range(1, len(tests) + 1), key=worth)]
        rule = Rule(tuple(tests), 0.0)
        held = rule.holds(table, n) & left
        precision = bad[held].sum() / max(1, held.sum())
        if precision < least_precision or bad[held].sum() < least_cover:
            break
        rules.append(Rule(rule.tests, float(precision)))
        left &= ~held
    return rules


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = 30_000) -> list[Rule]:
    """From at most max_rows labelled keys of the training fold, those with the smallest hashes; label 0 is bad.

    Null keys and labels are ignored; of several labels of a key the larger counts, of several rows of a key the least.
    """
    known = only(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & in_training_fold(key)).groupBy(key).agg(F.max(label).alias("good"))
    picked = F.broadcast(known.orderBy(F.xxhash64(key), key).limit(max_rows))  # at most max_rows rows of two numbers
    one = stats.join(picked, key).groupBy(key, "good").agg(F.min(F.struct(*COUNTS)).alias("c"))
    # the order of rows tells which grow and which prune
    got = one.select(key, "good", "c.*").orderBy(F.xxhash64(key), key).toPandas()  # at most max_rows rows, a few numbers each
    if not len(got):
        return []
    return learn(ratios({c: got[c].to_numpy() for c in COUNTS}), got["good"].to_numpy() != 1)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, the rule that decided or null), as ordered conditional expressions."""
    if not rules:
        return F.lit(True), F.lit(None).cast("string")
    kept, why = F, F
    for r in rules:
        kept, why = kept.when(r.column(), F.lit(False)), why.when(r.column(), F.lit(str(r)))
    return kept.otherwise(F.lit(True)), why.otherwise(F.lit(None).cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, the counts, ``base_failed``, ``kept`` and the deciding ``rule``, one row per input row.

    Null texts count as empty: no words, hence base_failed; long texts are read whole.  Null keys stay in
    the result but match no label.  Repeated rows are judged each, and equal texts alike.  Extra columns
    are ignored.  Without labels no rule is learned, and only the base decides; an empty table gives an empty result.
    """
    stats = written(text_counts(docs, key, text), "rule-counts")
    kept, why = verdict(fit(stats, labels, key))
    return stats.select(key, *BASE, base_failed().alias("base_failed"), (~base_failed() & kept).alias("kept"), why.alias("rule"))
