"""Near-duplicate documents by SimHash, linked through vantage-point trees.

A fingerprint is the majority of the XXH64 bits of a text's 3-word shingles. The distinct fingerprints are dealt out by a
vantage-point tree over Hamming distance whose top is built from a bounded sample: a fingerprint nearer to a vantage point
than its radius goes inside, the others outside, and one that lies within reach of the border goes to both shards, so that by
the triangle inequality any two linked fingerprints meet in one shard at least. Each shard goes on splitting in the same way
and compares exactly what is left in a leaf. Shards return spanning forests, never all pairs of a group; the groups are
then joined by distributed connected components.

Copies collapse to one fingerprint before any linking, so groups of copies cost one row each. A null or empty text has the
fingerprint zero and links like any other; a null doc_id counts in no minimum, and a group that has no other id gets a null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import appended, components, fresh, local_roots, staged, word_blocks

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints (about) that the top of the tree is built from, those that a shard aims at, and those that a leaf compares directly.
SAMPLE, SHARD, LEAF = 65_536, 4_096, 384


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    counts, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(text):
        words = tail + words
        if len(words) >= width:
            hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        tail = words[-(width - 1) :]
    if not n:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the 64 bits as a long."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return appended(rows, "fp long", make, drop=("text",))


class Tree:
    """A vantage-point tree kept as rows (vantage point, radius, inside, outside); a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, seed: int = 7):
        self.rows: list[tuple[int, int, int, int]] = []
        self.leaves, self.radius, self.rng = 0, radius, np.random.default_rng(seed)
        self.root = self._grow(sample, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        split = best_split(points, self.radius, self.rng) if len(points) > leaf else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        vantage, mu, d = split
        at = len(self.rows)
        self.rows.append((0, 0, 0, 0))
        self.rows[at] = (int(vantage), mu, self._grow(points[d <= mu], leaf), self._grow(points[d > mu], leaf))
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index of the point) for every shard that a point goes to."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            at, idx = todo.pop()
            if not len(idx):
                continue
            if at < 0:
                out.append((np.full(len(idx), -at - 1), idx))
                continue
            vantage, mu, inside, outside = self.rows[at]
            d = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int16)
            todo += [(inside, idx[d <= mu]), (outside, idx[d > mu - self.radius])]
        if not out:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point and radius, of a few, that copy the fewest points across the border; None if no split helps."""
    best = None
    for v in rng.choice(points, tries):
        d = np.bitwise_count(points ^ v).astype(np.int16)
        sizes = np.bincount(d, minlength=65).cumsum()
        inside, outside = sizes[:64], len(points) - np.r_[np.zeros(radius, int), sizes][:64]
        worst = np.maximum(inside, outside)
        cost = np.where((inside > 0) & (inside < len(points)) & (worst < 0.85 * len(points)), (inside + outside) * (1 + np.maximum(0, worst / len(points) - 0.6)), np.inf)
        mu = int(cost.argmin())
        if cost[mu] < (best[0] if best else np.inf):
            best = (cost[mu], v, mu, d)
    return best and best[1:]


def linked(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, index of the least one it reaches) among points, by splitting down to leaves; also() says which pairs of indices within the radius are links."""
    a, b, rng, todo = [], [], np.random.default_rng(11), [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        own = points[idx]
        split = best_split(own, radius, rng, 2) if len(idx) > leaf else None
        if split is not None:
            _, mu, d = split
            todo += [idx[d <= mu], idx[d > mu - radius]]
            continue
        step = max(1, min(1024, (1 << 21) // max(len(idx), 1)))
        for at in range(0, len(idx), step):  # a leaf, or what no vantage point can tell apart
            i, j = np.nonzero(np.bitwise_count(own[at : at + step, None] ^ own[None, :]) <= radius)
            keep = i + at < j
            i, j = idx[i[keep] + at], idx[j[keep]]
            if also is not None:
                ok = also(i, j)
                i, j = i[ok], j[ok]
            if len(i) > 4 * len(idx):
                r = local_roots(len(points), i, j)
                i = np.flatnonzero(r != np.arange(len(points)))
                j = r[i]
            a.append(i)
            b.append(j)
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    root = local_roots(len(points), np.concatenate(a), np.concatenate(b))
    i = np.flatnonzero(root != np.arange(len(points)))
    return i, root[i]


def edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links among the values of column fp."""
    n = distinct.count()
    # a threshold of a hash leaves SAMPLE of them on average, wherever they lie
    below = int(2**63 * min(1.0, SAMPLE / max(n, 1)))
    sample = np.array(sorted(r[0] for r in distinct.select("fp").filter((F.xxhash64("fp").bitwiseAND(F.lit(2**63 - 1))) < F.lit(min(below, 2**63 - 1))).collect()), np.int64).view(np.uint64)
    shards = max(64, -(-n // SHARD))
    tree = Tree(sample, max(8, len(sample) // shards), radius)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shard, idx = tree.route(b["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"shard": shard, "fp": b["fp"].to_numpy()[idx]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy())
        i, j = linked(fp.view(np.uint64), radius)
        return pd.DataFrame({"a": fp[i], "b": fp[j]})

    return distinct.select("fp").mapInPandas(deal, "shard int, fp long").groupBy("shard").applyInPandas(compare, "a long, b long")


def _grouped(documents: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, table): for each distinct fingerprint its group's first row (no_id, doc_id, text_hash)."""
    fps = staged(fingerprints(documents))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    distinct = staged(fps.groupBy("fp").agg(first))
    roots = components(edges(distinct, radius))
    linked_ = staged(distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first"))
    least = linked_.groupBy("root").agg(F.min("first").alias("least"))
    of = linked_.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "root", "least")
    table = distinct.join(of, distinct.fp == of._fp, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("first"))
    return fps, table


def groups(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents."""
    fps, table = _grouped(documents, radius)
    return fps.join(table.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def representatives(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """documents with one row of each group left: its least doc_id's, and of that one's texts the one of the least hash."""
    return one_of_each(documents, *_grouped(documents, radius))


def one_of_each(documents: DataFrame, rows: DataFrame, table: DataFrame) -> DataFrame:
    """Of rows (doc_id, text_hash) the documents that come first (column first) in a group (root) of table."""
    key, many, i, h = (fresh(x, documents) for x in ("key", "many", "first_id", "first_hash"))
    kept = table.select("root", "first.doc_id", "first.text_hash").distinct()
    again = rows.join(kept.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h)))
    kept = staged(again.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.count(F.lit(1)).alias(many)))
    keyed = documents.withColumn(key, F.xxhash64("text"))
    left = keyed.join(kept, keyed["doc_id"].cast("long").eqNullSafe(kept[i]) & (keyed[key] == kept[h])).select(*documents.columns, many, i, h)
    if kept.filter(F.col(many) > 1).isEmpty():
        return left.select(*documents.columns)
    row = F.struct(*documents.columns)
    first = left.filter(F.col(many) > 1).groupBy(i, h).agg(F.min_by(row, F.to_json(row)).alias(key)).select(f"{key}.*")  # rows that repeat id and text
    return left.filter(F.col(many) == 1).select(*documents.columns).unionByName(first)


def query(documents: DataFrame) -> DataFrame:
    return groups(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
