"""Small tables with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else "".join(rng.choice(("er", "on", "ti", "sh", "an", "ré", "ß")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.choice((3, 20, 60, 120)))
        if rng.random() < 0.15:
            t += "\nPermission is given. Released under the MIT License.\n" + t.split(" ")[0]
        rows.append([i, t, "en", "hot" if rng.random() < 0.4 else f"s{i % 5}", len(t)])
    base = rows[3][1].split() + prose(rng, 100).split()
    for k in range(12):  # a group of near copies, among them exact ones
        w = list(base)
        for j in rng.sample(range(len(w)), k // 2):
            w[j] = f"x{k}{j}"
        rows.append([n + k, " ".join(w), "en", "hot", 0])
    rows += [[n + 20, None, None, None, None], [n + 21, "", "en", "s1", 0], [n + 22, "   \n\t ", "en", "s1", 6], [n + 23, "one", "en", "s1", 3], [n + 24, "ONE", "en", "s1", 3], [n + 25, "a b c", "en", None, 5], [n + 26, "long " * 30_000 + prose(rng, 3000), "en", "s2", 0], [n + 27, "Apache License apache  LICENSE mit license", "en", "s2", 9]]
    rows += [[n + 28, rows[7][1], "en", "s3", 1], [n + 29, rows[7][1], "en", "s3", 1]]
    return [tuple(r) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd(df):
    """With columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("score", "shard", "n", "size", "node", "p", "key", "length", "h", "good", "y", "block")})


def jaccard(rows, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = WS.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def decontamination(rows, items, window=13):
    found = {}
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(len(w) - window + 1 if len(w) >= window else min(1, len(w))):
            windows.setdefault(tuple(w[k : k + min(window, len(w))]), set()).add(str(i))
    for i, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        hit, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    names |= who
        h = sum(hit)
        found[i] = (len(w), h, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return found


def counts(text):
    text = text or ""
    w = WS.findall(text)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    mark = [False] * len(w)
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            mark[k] = mark[k + 1] = mark[k + 2] = True
    lines = [x for x in text.split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), sum(mark)


def licenses(text):
    w = ALNUM.findall(lower(text))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def longest_common(pairs):
    """Longest chain of pairs that grows in both, by comparing all of them."""
    best = {}
    for p, q in sorted(pairs):
        best[p, q] = 1 + max((n for (a, b), n in best.items() if a < p and b < q), default=0)
    return max(best.values(), default=0)


def notice_labels(text, notices, drift=3, least=0.6):
    """{label: best share} of the notices, trying every band of diagonals."""
    w = ALNUM.findall(lower(text))
    grams = [tuple(w[k : k + 2]) for k in range(len(w) - 1)]
    out = {}
    for label, notice in notices:
        t = ALNUM.findall(lower(notice))
        want = [tuple(t[k : k + 2]) for k in range(len(t) - 1)]
        pairs = [(p, q) for p, g in enumerate(grams) for q, h in enumerate(want) if g == h]
        width = min(drift, (len(t) - 1) // 2)
        best = max((longest_common([(p, q) for p, q in pairs if d <= p - q <= d + width]) for d in {p - q for p, q in pairs}), default=0)
        if best / len(want) >= least:
            out[label] = best / len(want)
    return out


def need(a, b, percent=85):
    return math.ceil(percent * (a + b) / (100 + percent))
