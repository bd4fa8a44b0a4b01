"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the windows of ordinary documents and one on those windows of toxic documents that hold grams which
mark them; dictionaries trained on all windows were measured and left (see the README). A window (a
word between its spaces) is compressed under both, set between two passages that both dictionaries hold: without them a frame
that short would fall back to stored bytes and the lengths would say nothing. The bytes that the toxic dictionary saves are
the window's distance; a document's distances are counted against a ladder of thresholds, and a logistic regression on
labelled documents that trained no dictionary turns the counts into a calibrated probability.

The model is a few kilobytes, fitted on at most ``FIT_TOXIC`` and ``FIT_ORDINARY`` labelled documents; scoring reads each whole text
once, map-only. A null or empty text has no window and gets the score of a document in which nothing toxic was found; without any label
every score is the same, 0.12. Rows that repeat are scored once each, equal texts equally; other columns pass through, and one called like the
score is replaced.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import appended, crc_mod, labelled_sample, word_blocks

#: Labelled documents of each class that the fit may use; the bound that keeps the fit on the driver.
FIT_TOXIC, FIT_ORDINARY = 1500, 3000
GRAM, DICT_BYTES, LEVEL, CACHE = 5, 16384, 6, 400_000
#: A gram marks toxic text if this share of the toxic documents (two at least) hold it, and that is this many times its share of the ordinary ones.
LEAST_SHARE, LIFT = 0.004, 30.0
THRESHOLDS = (1, 2, 3, 4, 5)
#: One labelled document in so many calibrates.
CALIBRATED = 3


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    before: bytes
    after: bytes
    weights: tuple[float, ...]


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def _content(trained: bytes) -> bytes:
    """A trained dictionary without its header: the content follows the three starting repeat offsets 1, 4 and 8."""
    at = trained.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
    return trained[at + 12 :] if at >= 0 else trained


def _train(samples: list[bytes], size: int, k: int) -> bytes:
    """Trained content; where the trainer refuses (too few samples), the samples themselves, the most frequent last."""
    try:
        return _content(zs.train_dictionary(size, samples, k=k, d=6).as_bytes())
    except zs.ZstdError:
        return b"".join(w for w, _ in reversed(Counter(samples).most_common()))[-size:]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.pair = [self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        d = zs.ZstdCompressionDict(content or b" " * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
        p = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        return zs.ZstdCompressor(dict_data=d, compression_params=p)

    def distance(self, word: bytes) -> int:
        if (v := self.memo.get(word)) is None:
            if len(self.memo) >= CACHE:
                self.memo.clear()
            x = b"%b %b %b" % (self.model.before, word, self.model.after)
            v = len(self.pair[0].compress(x)) - len(self.pair[1].compress(x))
            if len(word) <= 64:
                self.memo[word] = v
        return v

    def features(self, text: str | None) -> list[float]:
        seen: Counter[int] = Counter()
        for words in word_blocks(text):
            seen.update(map(self.distance, words))
        counts = [sum(n for d, n in seen.items() if d >= t) for t in THRESHOLDS]
        total = sum(seen.values())
        return [*np.log1p(counts), *np.minimum(counts, 2), min(max(seen, default=0), 8), np.log1p(total), np.log1p(1000 * counts[2] / (total + 50))]

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 2 * len(THRESHOLDS) + 3)
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pen, x.T @ (p - y) + pen @ w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _different(text: str | None) -> set[bytes]:
    return {w for ws in word_blocks(text) for w in ws}


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """The model of two lists of texts: every ``CALIBRATED``th text of each calibrates, all others train the dictionaries (of a single text, both)."""
    (cal_t, fit_t), (cal_o, fit_o) = (((x[::CALIBRATED], [t for i, t in enumerate(x) if i % CALIBRATED]) if len(x) > 1 else (x, x)) for x in (toxic, ordinary))

    def held_by(texts: list[str]) -> Counter:
        out: Counter[bytes] = Counter()
        for t in texts:
            out.update({g for w in _different(t) for g in _grams(w)})
        return out

    a, b = held_by(fit_t), held_by(fit_o)
    least = max(2, LEAST_SHARE * len(fit_t))
    marks = {g for g, n in a.items() if n >= least and n / len(fit_t) >= LIFT * (b[g] + 0.5) / (len(fit_o) + 1)}
    del a, b
    rng = random.Random(42)
    bad = [b" %b " % w for t in fit_t for ws in word_blocks(t) for w in ws if len(_grams(w) & marks) >= 2]
    usual = [b" %b " % w for t in fit_o for w in sorted(_different(t))]
    rng.shuffle(bad)
    rng.shuffle(usual)
    base = _train(usual, 6144, 32)
    model = Model(_train(bad, DICT_BYTES, 24), base, base[-32:-8], base[-200:-176], ())
    s = Scorer(model)
    width = 2 * len(THRESHOLDS) + 3
    if not toxic and not ordinary:
        return Model(model.toxic, base, model.before, model.after, (-2.0, *[0.0] * width))
    x = np.array([s.features(t) for t in [*cal_t, *cal_o]], float).reshape(-1, width)
    y = np.r_[np.ones(len(cal_t)), np.zeros(len(cal_o))]
    return Model(model.toxic, base, model.before, model.after, tuple(map(float, _logistic(x, y))))


def fit(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Model:
    """Learns from labels.toxic of documents outside the held-out fold (crc32(doc_id) mod `mod` = `held`)."""
    rows = labelled_sample(documents, labels, "toxic", FIT_ORDINARY, mod, held)
    toxic = [r.text or "" for r in rows.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_TOXIC).select("text").collect()]
    ordinary = [r.text or "" for r in rows.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").select("text").collect()]
    return fit_texts(toxic, ordinary)


def score(documents: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """documents with a probability of being toxic; map-only."""

    def make():
        s = Scorer(model)
        return lambda texts: [s.score(texts)]

    return appended(documents, f"`{column}` double", make)


def query(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    out = score(documents.select("doc_id", "text"), fit(documents, labels), "score").drop("text")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
