"""Near-duplicate documents by SimHash and vantage-point trees, verified by the Jaccard similarity of their 5-word shingles.

A fingerprint is the majority of ``64 * WORDS`` bits of a text's different shingles. Two texts of similarity s differ in a bit with probability
acos(2s / (1 + s)) / pi or less, 0.15 at 0.8. One wide radius over a whole fingerprint can't be searched: it is many deviations of the distances of unrelated
fingerprints, so a vantage point's border would hold nearly all of them. Therefore the fingerprint is cut into ``TABLES`` parts of ``BITS`` bits, and each part has a
vantage-point tree of its own with the small radius ``NEAR`` (see simhash): any two parts within it meet in a shard. A pair of similarity 0.8 is that near in one part with
probability 0.17, and in none of all with 0.0005; more alike pairs are lost less often.

Texts that are near in a part are candidates if the first ``CHECKED`` longs of their fingerprints differ in ``APART`` bits at most (a pair of 0.8 fails that with
probability 0.00002; unrelated ones pass with 0.000001). A shard's connected candidates are a group; stars ties, splits and compares its rows. Every pair whose
whole fingerprints are not too far apart (far, five deviations) is verified exactly, and the links' connected groups keep one document.

Copies collapse by a hash of the text before any linking. Texts without a word, and null ones, are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import simhash, stars
from tempora.llm.common import appended, column, staged, trim, word_blocks
from tempora.llm.simhash import one_of_each

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: Longs of a fingerprint, its parts, the bits of a part, and the bits in which near parts may differ.
WORDS, TABLES, BITS, NEAR = 13, 41, 20, 1
#: Longs of a fingerprint that candidates compare, and the bits in which they may differ.
CHECKED, APART = 2, 36
#: Texts (about) that the trees' tops are built from, parts that a shard aims at, and rows of a group that are compared in all pairs.
SAMPLE, SHARD, SMALL = 16_384, 65_536, 64


def fingerprint(hashes: np.ndarray, block: int = 255) -> bytes:
    """The majority bits of WORDS mixes of each hash; zeros without one."""
    salts = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), block):  # a byte counts a block's bits
        h = hashes[at : at + block, None] + salts
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def wholes(fps: list[bytes]) -> np.ndarray:
    """A row of WORDS longs for each fingerprint."""
    return np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS)


def part(whole: np.ndarray, t: int) -> np.ndarray:
    """The t-th part of each fingerprint, as numbers."""
    first = t * BITS // 8
    own = whole.view(np.uint8)[:, first : first + BITS // 8 + 2].astype(np.uint32)
    number = np.zeros(len(own), np.uint32)
    for k in range(4):
        number = number << np.uint32(8) | (own[:, k] if k < own.shape[1] else np.uint32(0))
    return number << np.uint32(t * BITS % 8) >> np.uint32(32 - BITS)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles; of a shorter text the hash of all its words."""
    found, tail, n = [], [], 0
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(text):
        words = tail + words
        if len(words) >= width:
            found.append(np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), np.uint64)))
            n += 1
        tail = words[-(width - 1) :]
    if n:
        return np.unique(np.concatenate(found))
    return np.array([digest(b" ".join(tail), SEED)] if tail else [], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, fp) of every row: n is the number of different shingles, fp the fingerprint's bytes."""

    def make():
        def work(texts):
            sizes, fps = [], []
            for t in texts:
                own = shingles(t)
                sizes.append(len(own))
                fps.append(fingerprint(own))
            return sizes, fps

        return work

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return appended(keyed, "n int, fp binary", make, drop=("text",))


def far(least: float) -> int:
    """Bits of a whole fingerprint that texts of similarity `least` differ in at most, but for five deviations of chance."""
    bits = 64 * WORDS
    share = float(np.arccos(min(1.0, 2 * least / (1 + least)))) / np.pi
    return int(bits * share + 5 * (bits * share * (1 - share)) ** 0.5)


def candidates(values: np.ndarray, checked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of its group) of the rows that are in a group of more than one, among parts (values) and the longs to compare of their fingerprints."""
    order = np.lexsort((*checked.T, values))
    sorted_ = np.column_stack([values[order].astype(np.uint64), checked[order]])
    new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(1)][: len(order)]
    of = np.empty(len(order), int)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    own, bits = values[first], checked[first]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(bits[i, k] ^ bits[j, k]).astype(np.uint16) for k in range(CHECKED)) <= APART

    i, r = simhash.linked(own, NEAR, also=alike)
    root = np.arange(len(first))
    root[i] = r
    group = root[of]
    rows = np.flatnonzero(np.bincount(group, minlength=len(first))[group] > 1)
    return rows, group[rows]


def memberships(distinct: DataFrame) -> DataFrame:
    """The texts of distinct (text_hash, fp) that are candidates, as stars.MET has them.

    Parts travel in packed arrays, one row for each shard of a batch's parts.
    """
    n = distinct.count()
    below = min(int(2**63 * min(1.0, SAMPLE / max(n, 1))), 2**63 - 1)
    sample = wholes(sorted(bytes(r[0]) for r in distinct.select("fp").filter(F.xxhash64("text_hash").bitwiseAND(F.lit(2**63 - 1)) < F.lit(below)).collect()))
    shards = max(1, -(-n // SHARD))
    trees = [simhash.Tree(part(sample, t).astype(np.uint64), max(8, -(-len(sample) // shards)), NEAR, t) for t in range(TABLES)]
    base = np.cumsum([0, *(tree.leaves for tree in trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, whole, out = column(b, "text_hash").to_numpy(), wholes(column(b, "fp").to_pylist()), []
            every = whole.view(np.uint8)
            for t, tree in enumerate(trees):
                values = part(whole, t)
                shard, idx = tree.route(values)
                order = np.argsort(shard, kind="stable")
                shard, idx = shard[order], idx[order]
                # bytes of other parts, which split large groups
                more = every[:, [8 * CHECKED + (4 * t + 7 * k) % (8 * (WORDS - CHECKED)) for k in range(4)]]
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else [0]
                for x, y in zip(cuts, cuts[1:]):
                    own = idx[x:y]
                    out.append((int(base[t] + shard[x]), *(c[own].tobytes() for c in (node, values, whole[:, :CHECKED], more))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[c] for r in out], pa.binary()) for c in range(1, 5))], names=["part", "node", "value", "checked", "more"])
        trim()

    def meet(table: pa.Table) -> pa.Table:
        node, value, checked, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("node", np.int64), ("value", np.uint32), ("checked", np.uint64), ("more", np.uint8)))
        rows, key = candidates(value, checked.reshape(-1, CHECKED))
        return stars.met(table.column("part")[0].as_py(), key.astype(np.uint64), node[rows], list(more.reshape(-1, 4)[rows].T), SMALL)

    rows = distinct.select("text_hash", "fp").mapInArrow(deal, "part int, node binary, value binary, checked binary, more binary")
    return rows.groupBy("part").applyInArrow(meet, stars.MET)


def roots(documents: DataFrame, distinct: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root): the connected groups of similar texts among distinct (text_hash, n, fp)."""
    met = staged(memberships(distinct))
    docs = documents.select(F.xxhash64("text").alias("node"), "text").join(met.select("node").distinct(), "node")
    texts = staged(docs.groupBy("node").agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: dict[int, np.ndarray] = {}
            a, c, ok = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for r, (i, j) in enumerate(zip(a, c)):
                if len(kept) > 64:
                    kept.clear()
                for node, col in ((i, 2), (j, 3)):
                    if node not in kept:
                        kept[node] = shingles(b.column(col)[r].as_py())
                ok.append(similar(kept[i], kept[j], least))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        trim()

    most = far(least)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (wholes(column(b, c).to_pylist()) for c in ("x", "y"))
            yield b.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= most))

    def verify(pairs: DataFrame) -> DataFrame:
        size = distinct.select("text_hash", "n", "fp")
        pairs = pairs.join(size.toDF("a", "s", "x"), "a").join(size.toDF("b", "t", "y"), "b").filter(F.least("s", "t") >= F.lit(least) * F.greatest("s", "t") - 1e-9)
        pairs = pairs.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
        return pairs.select("a", "b").join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    return stars.roots(met, verify)


def representatives(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """documents with one row of each group left, chosen as simhash.representatives does."""
    rows = staged(sketches(documents))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    distinct = staged(rows.groupBy("text_hash").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp")))
    own = roots(documents, distinct, least)
    linked = staged(distinct.join(own, distinct.text_hash == own.node).select("text_hash", "root", "first"))
    best = linked.groupBy("root").agg(F.min("first").alias("least"))
    of = linked.select(F.col("text_hash").alias("_t"), "root").join(best, "root")
    table = distinct.join(of, distinct.text_hash == of._t, "left").select(F.coalesce("root", "text_hash").alias("root"), F.coalesce("least", "first").alias("first"))
    return one_of_each(documents, rows, table)
