"""A quality classifier by positive-unlabelled learning with the non-negative risk.

Data.  P: texts that trusted labels call good.  U: every text of the corpus, whatever its
label.  Bad examples are never shown to the learner; labels other than 1 are not read.

Prior.  Good texts are a share pi of U, so U(A) >= pi P(A) for every set A of texts, with equality
where A holds no bad ones.  The estimate is the least U(A) / P(A), each moved by a standard error
against the luck of the least, over all intervals of the features and all intersections of
two of them that hold a twentieth of P; their masses are the entries of the moment matrices below.

Model.  ``g(x) = w . phi(x)``, where phi holds indicator functions of intervals of some
ratios (upper case, marks, repeats, ...), so the model is a sum of step functions.  With the
squared loss ``l(z) = (1 - z)^2 / 4`` every part of the risk is a quadratic form in w:

    R(w) = pi R_P+(w) + max(0, R_U-(w) - pi R_P-(w))

and depends on the data only through the mean and the second-moment matrix of phi over P
and over U.  Both are summed over *all* rows in one pass over a narrow table, so nothing is
sampled, and what reaches the driver is one matrix of fixed size.  The driver then
minimises R: in closed form where the inner term is not negative there, else by gradient
steps, which go against the inner term while it is negative (that keeps a flexible model from fitting noise);
the best point met with an inner term that is not negative is taken.  The minimiser of the
squared loss is ``2 P(good|x) - 1``, hence the score ``(g + 1) / 2``, clipped to [0, 1].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import as_bytes, in_training_fold, map_rows, only, written
from quern.llm.features import COUNTS, counts, text_counts

#: Ratios in [0, 1] (numerator, denominator) and the borders of their intervals, fixed.
RATIOS = (("n_upper", "n_letters"), ("n_symbols", "n_chars"), ("n_marks", "n_chars"), ("n_pipes", "n_words"), ("n_bangs", "n_words"), ("n_digits", "n_chars"), ("n_repeat_words", "n_words"), ("n_twin_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_distinct", "n_words"), ("n_ends", "n_words"))
BORDERS = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95])
LENGTHS = np.array([1, 5, 20, 50, 100, 1000])
SIZE = 1 + len(RATIOS) * (len(BORDERS) + 1) + len(LENGTHS) + 1


def phi(table: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of indicators; a constant 1 comes first."""
    table = table | {"n_letters": table["n_upper"] + table["n_lower"]}
    n = len(table["n_words"])
    out = np.zeros((n, SIZE))
    out[:, 0] = 1
    at = 1
    for a, b in RATIOS:
        r = table[a] / np.maximum(table[b], 1)
        out[np.arange(n), at + np.searchsorted(BORDERS, r, side="right")] = 1
        at += len(BORDERS) + 1
    out[np.arange(n), at + np.searchsorted(LENGTHS, table["n_words"], side="right")] = 1
    return out


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features @ self.weights + 1) / 2, 0, 1)


def minimise(mean_p: np.ndarray, second_p: np.ndarray, mean_u: np.ndarray, second_u: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """The minimiser of the risk; where its inner term would be negative, the best point of gradient steps at which it is not."""

    def risk(mean: np.ndarray, second: np.ndarray, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        return (1 - 2 * sign * mean @ w + w @ second @ w) / 4, (second @ w - sign * mean) / 2

    # without the clamp the risk is one quadratic form, whose minimum is a linear system; the steps start there
    w = np.linalg.solve(second_u + 2 * ridge * np.eye(len(mean_u)), 2 * prior * mean_p - mean_u)
    if risk(mean_u, second_u, w, -1)[0] >= prior * risk(mean_p, second_p, w, -1)[0]:
        return w
    # back towards zero, where the inner term is (1 - prior) / 4, until it is not negative: a root of a quadratic
    bend, slope = (w @ second_u @ w - prior * w @ second_p @ w) / 4, (mean_u @ w - prior * mean_p @ w) / 2
    roots = np.roots([bend, slope, (1 - prior) / 4])
    w = w * min((r.real for r in roots if abs(r.imag) < 1e-12 and 0 < r.real <= 1), default=0.0)
    # preconditioned by the diagonal of U's second moments: indicators of rare intervals move as fast as common ones
    scale = 1 / np.sqrt(np.diag(second_u) + ridge)
    step = 1.8 / (np.linalg.eigvalsh(scale[:, None] * (second_u + prior * second_p) * scale)[-1] + ridge)
    best, found = np.inf, w
    for v in (np.zeros_like(w), w):
        for _ in range(steps):
            plus, up = risk(mean_p, second_p, v, 1)
            u, gu = risk(mean_u, second_u, v, -1)
            p, gp = risk(mean_p, second_p, v, -1)
            inner = u - prior * p
            if inner >= -1e-12 and (now := prior * plus + max(0.0, inner) + ridge * v @ v / 2) < best:
                best, found = now, v
            grad = prior * up + ridge * v + gu - prior * gp if inner >= 0 else prior * gp - gu
            v = v - step * scale * scale * grad
    return found


def class_prior(n_p: float, second_p: np.ndarray, n_u: float, second_u: np.ndarray, least_mass: float = 0.05) -> float:
    """The share of good texts in U, from the mean second moments of P and U; within 0.02 .. 0.98."""
    error = lambda m, n: np.sqrt(np.maximum(m * (1 - m), 0) / n)
    mass = second_p - error(second_p, n_p)
    upper = (second_u + error(second_u, n_u)) / np.where(mass > 0, mass, np.inf)
    # the constant's own mass is 1 on both sides, so there is always a set
    return float(np.clip(upper[(second_p >= least_mass) & (mass > 0)].min(), 0.02, 0.98))


def _moments(rows: DataFrame, columns: tuple[str, ...], flag: str) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Counts and sums of phi phi' over the flagged rows and over all; one row of fixed size per partition reaches the last sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE, SIZE))
        for b in batches:
            x = phi({c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)})
            good = b.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
            total[0] += x[good].T @ x[good]
            total[1] += x.T @ x
        flat = total.reshape(-1)
        kept = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(flat[kept])], names=["cell", "v"])

    sums = rows.select(*columns, flag).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(2 * SIZE * SIZE)
    for r in sums.toLocalIterator():  # at most 2 SIZE^2 cells, whatever the input
        out[r["cell"]] = r["v"]
    out = out.reshape(2, SIZE, SIZE)
    return out[0, 0, 0], out[0], out[1, 0, 0], out[1]


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", default_prior: float = 0.8) -> PuModel:
    """Learn from the statistics of all rows and the labels 1 of the training fold.

    Labels that are null are ignored; of several labels of one key the larger counts.  Without a
    positive example every score is default_prior.
    """
    known = only(labels, key, label).where(F.col(key).isNotNull() & (F.col(label) == 1) & in_training_fold(key)).select(F.col(key), F.lit(True).alias("good")).distinct()
    n_p, sum_p, n_u, sum_u = _moments(stats.join(known, key, "left").withColumn("p", F.coalesce("good", F.lit(False))), COUNTS, "p")
    if not n_p or not n_u:
        w = np.zeros(SIZE)
        w[0] = 2 * default_prior - 1
        return PuModel(w, default_prior)
    prior = class_prior(n_p, sum_p / n_p, n_u, sum_u / n_u)
    return PuModel(minimise(sum_p[0] / n_p, sum_p / n_p, sum_u[0] / n_u, sum_u / n_u, prior, ridge=max(1e-4, 1 / n_p)), prior)


def apply(stats: DataFrame, model: PuModel, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    columns = COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(phi({c: b.column(k + 1).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return stats.select(key, *columns).mapInArrow(run, T.StructType([stats.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) for each row.

    Null and empty texts are scored like any text (all counts zero), long ones are read whole.  Null keys
    are scored but never match a label.  Repeated rows count, and are scored, each; equal texts tie.
    Extra columns are ignored.  Empty tables give empty results.
    """
    stats = written(text_counts(docs, key, text), "text-counts")
    return apply(stats, fit(stats, labels, key), key, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, whose texts score threshold or more.

    Texts are scored where they are read; nulls, empty texts and repeated rows as in ``classify``.
    """
    model = fit(written(text_counts(docs, key, text), "text-counts"), labels, key)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t) for t in as_bytes(b.column(at))], np.int64).reshape(b.num_rows, len(COUNTS))
            yield b.filter(pa.array(model.score(phi(dict(zip(COUNTS, rows.T, strict=True)))) >= threshold))

    return map_rows(docs, run)
