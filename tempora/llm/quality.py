"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled of good quality; everything else that the fit sees is unlabelled web text. The class
prior is estimated from the two samples (the least ratio of their upper score tails), and an additive model over binned
text statistics minimises the non-negative unbiased PU risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with the logistic loss, so that its output is a probability.

The fit takes at most ``FIT_POSITIVE`` positives and ``FIT_UNLABELLED`` unlabelled documents, chosen by a hash of doc_id
outside the held-out fold; ids labelled both ways are no positives. Scoring reads each whole text once, map-only. A null or empty
text has zero statistics and is scored like any other; where nothing is labelled good, or there are no documents, every score is
0.5. Rows that repeat are scored once each, equal texts equally; other columns pass through, and one called like the
score is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import appended, crc_mod, labelled_sample, word_blocks

#: Bounds of the fit.
FIT_POSITIVE, FIT_UNLABELLED, BINS = 3000, 6000, 12
_UPPER, _LOWER, _DIGIT, _WORDY = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b",.;:'\"()-"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _WORDY)
FEATURES = 15


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; they don't depend on the blocks that its words are read in."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    words: Counter[int] = Counter()
    pairs: set[int] = set()
    n = n_pairs = marked = 0
    tail: list[int] = []
    for ws in word_blocks(text):
        hs = list(map(hash, ws))
        words.update(hs)
        n += len(ws)
        hs = tail + hs
        pairs.update(map(hash, zip(hs, hs[1:], hs[2:])))
        n_pairs += max(0, len(hs) - 2)
        marked += sum(1 for w in ws if w[-1] in _MARKS)
        tail = hs[-2:]
    upper, lower, lines = without(_UPPER), without(_LOWER), raw.count(b"\n") + 1
    parts = raw.split(b"\n")
    return [
        np.log1p(n), len(raw) / (n + 1), len(words) / (n + 1) * np.log1p(n), 1 - len(pairs) / n_pairs if n_pairs else 0.0,
        (words.most_common(1)[0][1] if n else 0) / (n + 5), upper / (upper + lower + 1), without(_DIGIT) / (len(raw) + 1), without(_MARKS) / (len(raw) + 1),
        marked / (n + 1), raw.count(b"|") / (n + 1), raw.count(b"!") / (n + 1), 1 - len(set(parts)) / lines, np.log1p(n / lines), without(_WORDY) / (n + 1), lines / (n + 1),
    ]


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, e in enumerate(self.edges):
            z += self.weights[j][np.searchsorted(e, x[:, j], side="left")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(edges) * (BINS + 1)), np.float32)
    for j, e in enumerate(edges):
        out[np.arange(len(x)), j * (BINS + 1) + np.searchsorted(e, x[:, j], side="left")] = 1
    return out


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk; where the negative part falls below zero, its gradient is undone, as the method has it."""
    w, b = np.zeros(p.shape[1] + 1), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    pu = np.hstack([np.vstack([p, u]), np.ones((len(p) + len(u), 1), np.float32)])
    for t in range(1, rounds + 1):
        z = np.clip(pu @ w, -30, 30)
        s = 1 / (1 + np.exp(-z))
        zp, su, sp = z[: len(p)], s[len(p) :], s[: len(p)]
        negative = np.logaddexp(0, z[len(p) :]).mean() - prior * np.logaddexp(0, zp).mean()
        down = np.r_[-prior * sp / len(p), su / len(u)]
        grad = np.r_[prior * (sp - 1) / len(p), np.zeros(len(u))] + down if negative >= 0 else -down
        g = pu.T @ grad + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(p: np.ndarray, u: np.ndarray, least: float = 0.2) -> float:
    """The share of positives in u, from scores: the least over thresholds of P(u above) / P(p above), with a margin for chance."""
    cuts = np.quantile(p, np.linspace(0, 1 - least, 60))
    pu, pp = (u[:, None] >= cuts).mean(0), (p[:, None] >= cuts).mean(0)
    margin = np.sqrt(1 / len(p)) + np.sqrt(1 / len(u))
    return float(np.clip(((pu + 0.5 * margin) / np.maximum(pp, 1e-9)).min(), 0.05, 0.98))


def fit_features(p: np.ndarray, u: np.ndarray) -> Model:
    both = np.vstack([p, u])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    for j, e in enumerate(edges):  # a statistic that is mostly one value has its bins in the tail
        tail = both[both[:, j] > e[BINS // 2], j]
        if e[0] == e[-2] and len(tail) >= BINS:
            edges[j] = np.quantile(tail, np.linspace(0, 1, BINS + 2)[:-2])
            edges[j][0] = e[0]
    bp, bu = _binned(p, edges), _binned(u, edges)
    w, b = _minimise(bp, bu, 0.5, 150)
    prior = class_prior(bp @ w + b, bu @ w + b)
    w, b = _minimise(bp, bu, prior)
    return Model(edges, w.reshape(len(edges), BINS + 1), b, prior)


def statistics(rows: DataFrame) -> np.ndarray:
    """The features of rows (doc_id, text), by doc_id; worked out where the texts are, so that only numbers come to the driver."""
    found = appended(rows.select("doc_id", "text"), "f array<double>", lambda: lambda texts: [[[float(v) for v in features(t)] for t in texts]], drop=("text",))
    return np.array([r.f for r in found.orderBy("doc_id").collect()], float).reshape(-1, FEATURES)


def fit(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Model:
    positive = statistics(labelled_sample(documents, labels, "quality", FIT_POSITIVE, mod, held).filter("label = 1"))
    spark = documents.sparkSession
    ids = documents.filter(F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != held)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_UNLABELLED)
    ids = spark.createDataFrame([(r[0],) for r in ids.collect()], "doc_id long")
    other = statistics(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    if not len(positive) or not len(other):
        return Model(np.zeros((FEATURES, BINS)), np.zeros((FEATURES, BINS + 1)), 0.0, 0.5)
    return fit_features(positive, other)


def score(documents: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """documents with the probability of good quality; map-only."""

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts], float).reshape(-1, FEATURES))]

    return appended(documents, f"`{column}` double", make)


def query(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    out = score(documents.select("doc_id", "text"), fit(documents, labels), "score").drop("text")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
