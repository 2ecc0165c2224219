"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Learning uses a bounded sample of labelled rows (``max_toxic`` and ``max_clean`` rows, those with
the smallest hashes of their ids).  It is cut into two halves: on the first a compact
lexicon is chosen, whole words and word stems that mark toxic texts (greedy cover); on
the second a logistic model over context features is fitted.

Matching.  The terms form a trie.  The Levenshtein automaton of each term (one edit from
five letters on, two from nine; an edit is an insertion, a deletion, a change or a swap of
neighbours) is intersected with the trie, and the product is made deterministic step by
step while words are read: a state is a set of (trie node, edits, letter due after a swap).
A word therefore costs one table look-up a letter, whatever the size of the lexicon, and
each distinct word of a batch is read once.  Stems match as exact prefixes.  A word that
is only near a term and occurs in clean training texts is a word of its own, not a
misspelling.

Context.  Each hit has a window of words around it.  A hit inside quotation marks, or next to
a word of reporting, counts as quotation and is kept apart from direct hits; hits close to
each other add up in the window score.  Scores lie in [0, 1]; texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import in_training_fold, map_rows, only, written

WINDOW = 12
STEM_LENGTHS = (3, 4, 5, 6, 7)
REPORTING = frozenset("said says called calls quote quoted quotes wrote word term dit appelé gesagt nannte sagte dijo llamó".split())
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_DRAWN_OUT = re.compile(r"(.)\1{2,}")
OPENING, CLOSING = "\"“«„‘`", "\"”»“’`"
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 300_000


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """words: term -> (weight, weight when misspelled); stems: prefix -> weight; benign: near words that are none."""

    words: dict[str, tuple[float, float]]
    stems: dict[str, float] = field(default_factory=dict)
    benign: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.matcher = Matcher(list(self.words))
        self.stem_lengths = sorted({len(s) for s in self.stems})

    def look_up(self, word: str) -> tuple[str, float] | None:
        """('exact' | 'near' | 'stem', weight) of a normalised word."""
        if word in self.words:
            return "exact", self.words[word][0]
        for n in self.stem_lengths:
            if n <= len(word) and word[:n] in self.stems:
                return "stem", self.stems[word[:n]]
        if word in self.benign:
            return None
        for w in dict.fromkeys((word, _DRAWN_OUT.sub(r"\1", word.translate(LEET)))):  # as written, then with letters for signs and drawn-out letters once
            if w and any(map(str.isalpha, w)) and (terms := self.matcher.find(w)):
                best = max(self.words[t][1] for t in terms)
                if best > 0:
                    return "near", best
        return None


class Matcher:
    """The product of a trie with the Levenshtein automata of its terms, made deterministic lazily."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.limit = [0]  # the most edits that any term below a node allows
        for t in terms:
            at = 0
            self.limit[0] = max(self.limit[0], edits_allowed(t))
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.limit.append(0)
                at = self.children[at][c]
                self.limit[at] = max(self.limit[at], edits_allowed(t))
            self.ends[at] = t
        self.alphabet = {c for x in self.children for c in x}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, ...]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0, "")}))

    def _close(self, items: set) -> frozenset:
        """With letters of the term left out."""
        todo, out = list(items), set(items)
        while todo:
            node, e, due = todo.pop()
            if not due:
                for child in self.children[node].values():
                    x = (child, e + 1, "")
                    if e + 1 <= self.limit[child] and x not in out:
                        out.add(x)
                        todo.append(x)
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            self.accepts.append(tuple(sorted({self.ends[n] for n, e, due in items if not due and self.ends[n] is not None and e <= edits_allowed(self.ends[n])})))
        return self.states[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, due in self.sets[state]:
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            if c in self.children[node]:
                out.add((self.children[node][c], e, ""))
            if e + 1 <= self.limit[node]:
                out.add((node, e + 1, ""))
            for a, child in self.children[node].items():
                if e + 1 <= self.limit[child]:
                    out.add((child, e + 1, ""))
                if c in self.children[child] and e + 1 <= self.limit[self.children[child][c]] and a != c:
                    out.add((self.children[child][c], e + 1, a))
        return self._state(self._close(out))

    def find(self, word: str) -> tuple[str, ...]:
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self.steps[state][c] = self._step(state, c)
            if nxt == self.dead:
                return ()
            state = nxt
        return self.accepts[state]


def normal(word: str) -> str:
    """Without what is no letter or digit at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


class Reader:
    """Turns texts into context features; remembers the words it has met, up to REMEMBERED."""

    FEATURES = 9

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known: set[str] = set()
        self.hot: dict[str, tuple[str, float]] = {}

    def hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        new = set(words) - self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.hot = set(), {}
            new = set(words)
        for w in new:
            if found := self.lexicon.look_up(normal(w)):
                self.hot[w] = found
        self.known |= new
        hot = self.hot
        return [(i, *hot[w]) for i, w in enumerate(words) if w in hot]

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """Inside quotation marks that open and close within the window, or beside a word of reporting."""
        near = words[max(0, i - 3) : i] + words[i + 1 : i + 2]
        if any(normal(w) in REPORTING for w in near):
            return True
        opens = closes = None
        for k in range(i, max(-1, i - WINDOW), -1):
            if words[k][0] in OPENING:
                opens = k
                break
            if k < i and words[k][-1] in CLOSING:
                break
        for k in range(i, min(len(words), i + WINDOW)):
            if words[k].rstrip(".,;:!?")[-1:] and words[k].rstrip(".,;:!?")[-1] in CLOSING:
                closes = k
                break
        return opens is not None and closes is not None

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        mass = {"exact": 0.0, "near": 0.0, "stem": 0.0}
        quoted, best, direct = 0.0, 0.0, []
        for i, kind, weight in self.hits(words):
            if self.quoted(words, i):
                quoted += weight
            else:
                mass[kind] += weight
                direct.append((i, weight))
        a, inside = 0, 0.0
        for i, weight in direct:  # the heaviest window
            inside += weight
            while direct[a][0] < i - WINDOW:
                inside -= direct[a][1]
                a += 1
            best = max(best, inside)
        total = sum(mass.values())
        return [1.0, np.log1p(mass["exact"]), np.log1p(mass["near"]), np.log1p(mass["stem"]), np.log1p(quoted), np.log1p(best), np.log1p(100 * total / (len(words) + 1)), float(total > 0), np.log1p(len(words)) / 10]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (sample_weight * p * (1 - p) + 1e-9)[:, None]).T @ x + keep
        d = np.linalg.solve(h, x.T @ (sample_weight * (y - p)) - keep @ w)
        w = w + d
        if np.abs(d).max() < 1e-8:
            break
    return w


def terms_of(words: set[str]) -> set[str]:
    """Words, and stems written with a star."""
    out = set(words)
    for w in words:
        for n in STEM_LENGTHS:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


def distinct_words(text: str | None) -> set[str]:
    return {n for w in set((text or "").lower().split()) if (n := normal(w)) and len(n) > 2 and not n.isdigit()}


def choose(toxic: list[set[str]], clean_df: dict[str, int], n_clean: int, explained_by: int = 8, least: int = 3) -> dict[str, float]:
    """Greedy cover: term after term, the one that explains most toxic texts not yet explained, if it is rare in clean ones.

    A text counts until ``explained_by`` terms explain it; choosing ends when no term explains ``least`` texts more.
    So each text's terms, and with them the lexicon, are bounded by the sample of texts and nothing else.
    Whole words go before stems of the same cover, higher odds before lower, longer terms
    before shorter ones, then by the alphabet.  The whole words that chosen stems hold are terms too.
    """
    n = max(1, len(toxic))
    df = Counter(t for x in toxic for t in x)
    odds = {t: float(np.log(((c + 0.5) / (n + 1)) / ((clean_df.get(t, 0) + 0.5) / (n_clean + 1)))) for t, c in df.items()}
    good = {t for t, c in df.items() if c >= least and odds[t] >= 2.5 and clean_df.get(t, 0) <= 0.1 * c}
    left: dict[str, set[int]] = {}
    held_by: dict[str, set[str]] = {}  # stem -> the terms that begin with it
    for i, x in enumerate(toxic):
        for t in x & good:
            left.setdefault(t, set()).add(i)
    for t in good:
        body = t.rstrip("*")
        for k in STEM_LENGTHS:
            if len(body) > k - (t[-1] != "*") and body[:k] + "*" in good and body[:k] + "*" != t:
                held_by.setdefault(body[:k] + "*", set()).add(t)

    def rank(t: str) -> tuple:
        return (-len(left[t]) * (1.02 if t[-1] != "*" else 1), -odds[t], -len(t), t)

    heap = [rank(t) for t in left]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    held: set[str] = set()
    covered: Counter = Counter()
    while heap:
        was = heapq.heappop(heap)
        t = was[-1]
        if t not in left:
            continue
        if (now := rank(t)) != was:  # covers only shrink, so a stale rank is too good
            heapq.heappush(heap, now)
            continue
        docs = left.pop(t)
        if len(docs) < least:
            continue
        out[t] = min(6.0, odds[t])
        for u in held_by.get(t, ()):  # what a chosen stem holds explains nothing more
            left.pop(u, None)
            if u[-1] != "*":
                held.add(u)
        for i in docs:
            covered[i] += 1
            if covered[i] >= explained_by:
                for u in toxic[i] & left.keys():
                    left[u].discard(i)
    # stems match as they are written only; the words they hold stay terms, so that misspellings are near these
    return out | {u: min(6.0, odds[u]) for u in sorted(held - out.keys())}


def _sample(labels: DataFrame, key: str, label: str, value: int, most: int) -> DataFrame:
    return labels.where(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(most).select(F.col(key), F.lit(value).alias("y"), (F.xxhash64(F.lit(7), F.col(key)) % 2 == 0).alias("first"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = 4000, max_clean: int = 12000) -> ToxicityModel:
    """Learn from the labels of the training fold; bounded by max_toxic and max_clean labelled rows, and by nothing else.

    The sampled texts are read in one pass and written; every later step reads these.  Null labels
    and keys are ignored, of several labels of a key the larger counts, of several texts of a key the least.
    Without toxic rows the lexicon is empty, and every score is small.
    """
    known = only(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & in_training_fold(key)).groupBy(key).agg(F.max(label).alias(label))
    totals = {int(r[0] > 0): r[1] for r in known.groupBy((F.col(label) > 0).cast("int")).count().toLocalIterator()}
    picked = F.broadcast(_sample(known, key, label, 1, max_toxic).union(_sample(known, key, label, 0, max_clean)))  # at most max_toxic + max_clean rows
    train = written(only(docs, key, text).join(picked, key).groupBy(key, "y", "first").agg(F.min(text).alias(text)), "labelled-texts")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([sorted(distinct_words(t))], pa.list_(pa.string()))], names=["words"])

    # the set of distinct words of at most max_toxic texts
    toxic = [terms_of(set(r["words"])) for r in train.where((F.col("y") == 1) & F.col("first")).select(text).mapInArrow(words_of, "words array<string>").toLocalIterator()]
    df = Counter(t for x in toxic for t in x)
    candidates = frozenset(t for t, c in df.items() if c >= 3)
    toxic = [x & candidates for x in toxic]
    exact = [t for t in candidates if t[-1] != "*"]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((candidates, exact))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, _ = shared.value
        total: Counter = Counter()
        n = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                total.update(terms_of(distinct_words(t)) & candidates)
        total["\0"] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys())), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    clean = train.where((F.col("y") == 0) & F.col("first")).select(text)
    clean_df = {r["term"]: r["n"] for r in clean.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    n_clean = clean_df.pop("\0", 0)
    chosen = choose(toxic, clean_df, n_clean)
    words = {t: w for t, w in chosen.items() if t[-1] != "*"}
    draft = Lexicon({t: (w, w) for t, w in words.items()}, {t[:-1]: w for t, w in chosen.items() if t[-1] == "*"})
    drafted = sc.broadcast((draft.words, draft.stems))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*drafted.value)
        found: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(w for w in distinct_words(t) if (hit := lexicon.look_up(w)) and hit[0] == "near")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    benign = frozenset(r["word"] for r in clean.mapInArrow(near, "word string").distinct().toLocalIterator())
    lexicon = Lexicon({t: (w, 0.7 * w) for t, w in words.items()}, draft.stems, benign)
    final = sc.broadcast((lexicon.words, lexicon.stems, lexicon.benign))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(*final.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([reader.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = train.where(~F.col("first")).select(text, "y").mapInArrow(seen, "y int, x array<double>").collect()  # at most the sampled rows, nine numbers each
    x = np.array([r["x"] for r in rows]).reshape(len(rows), Reader.FEATURES)
    y = np.array([r["y"] for r in rows], float)
    if not len(rows) or not y.any() or y.all():
        weights = np.zeros(Reader.FEATURES)
        weights[0], weights[1], weights[3] = -3, 2, 2
    else:
        weight = np.where(y > 0, totals.get(1, 1) / max(1, y.sum()), totals.get(0, 1) / max(1, (1 - y).sum()))
        weights = logistic(x, y, weight / weight.mean())
    return ToxicityModel(lexicon, weights)


def apply(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, score, predicted) for each row, repeated ones too; null and empty texts have no hits, long ones are read whole.

    Null keys are scored.  Extra columns are ignored; an empty table gives an empty result.  A score
    depends on the text and the model alone, so equal texts tie.
    """
    slim = only(docs, key, text)
    shared = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in batches:
            s = score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return slim.mapInArrow(run, T.StructType([slim.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def _share(docs: DataFrame, model: ToxicityModel):
    """The model, whose terms and near words all come from the bounded sample, for the tasks."""
    return docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.lexicon.benign, model.weights))


def _scorer(parts: tuple) -> Callable[[pa.Array], np.ndarray]:
    *lexicon, weights = parts
    model = ToxicityModel(Lexicon(*lexicon), weights)
    reader = Reader(model.lexicon)
    return lambda texts: model.score(np.array([reader.features(t) for t in texts.to_pylist()]).reshape(len(texts), Reader.FEATURES))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, whose texts score below threshold.

    Texts are scored where they are read.  Null and empty texts have no hits and stay, null keys and repeated rows are rows like any.
    """
    shared, at = _share(docs, fit(docs, labels, key, text)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) < threshold))

    return map_rows(docs, run)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``fit`` and ``apply``; see there for nulls, ties and empty tables."""
    return apply(docs, fit(docs, labels, key, text), key, text, threshold)
