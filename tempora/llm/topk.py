"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. Rather than sorting scores, each round counts them in bins over the interval that
still holds a query's kth score and narrows the interval to one bin; a task sends only the bins of its own k highest scores,
since lower ones cannot hold the global kth. When the intervals are one score wide, a last pass keeps the scores above the kth
value and, of those equal to it, each task's k smallest ids, and the ties are broken by id.

Queries are taken in blocks of ``QUERY_BLOCK`` vectors (the only thing that is broadcast, of a fixed size), so any number
of queries works. Vectors that are null, empty, or hold a null or non-finite component take no part; a query is compared with
vectors of its own length; an id that repeats is a candidate once for each of its rows, and its rows are no candidates
of its own query. Scores beyond a long are cut to a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import staged

QUERY_BLOCK, BINS, SCALE = 2048, 512, 1024
_LONG = (-(2**63), 2**63 - 1)


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), width)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, width, q): floor(scale * component) as little-endian longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, e in zip(b["vec_id"], b["embedding"]):
                x = np.floor(scale * np.asarray(e, np.float64))
                rows.append((i, len(x), np.clip(x, -(2.0**62), 2.0**62).astype("<i8").tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "width", "q"])

    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(whole).mapInPandas(run, "vec_id long, width int, q binary")


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products as longs: by floats where every sum stays below 2 ** 53, else by longs, else by Python's integers."""
    if not len(c) or not len(q):
        return np.zeros((len(c), len(q)), np.int64)
    most = float(np.abs(c.astype(float)).max()) * float(np.abs(q.astype(float)).max()) * c.shape[1]
    if most < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return c @ q.T
    return np.clip(c.astype(object) @ q.astype(object).T, *_LONG).astype(np.int64)


class _Block:
    """A block of queries, and for each the interval [low, low + width) that holds its kth score and how many lie above."""

    def __init__(self, rows, k: int):
        self.k, self.by_width, at = k, {}, 0
        for w in sorted({r.width for r in rows}):
            own = [r for r in rows if r.width == w]
            self.by_width[w] = (at, np.array([r.vec_id for r in own]), _matrix([r.q for r in own], w))
            at += len(own)
        self.ids = np.concatenate([x[1] for x in self.by_width.values()])

    def pairs(self, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(index of the first query, candidates' ids, scores, mask of the pairs that count)."""
        for w, (at, ids, q) in self.by_width.items():
            own = b[b["width"] == w]
            for i in range(0, len(own), 2048):
                part = own.iloc[i : i + 2048]
                c_ids = part["vec_id"].to_numpy()
                yield at, c_ids, _scores(_matrix(list(part["q"]), w), q), c_ids[:, None] != ids[None, :]


def _merged(top: np.ndarray | None, more: np.ndarray, k: int) -> np.ndarray:
    both = more if top is None else np.vstack([top, more])
    return both if len(both) <= k else np.partition(both, len(both) - k, axis=0)[-k:]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each row of queries; both tables as quantised() makes them."""
    spark = vectors.sparkSession
    queries = queries.dropDuplicates(["vec_id", "width", "q"]).orderBy("vec_id")
    blocks, rows = [], []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            blocks.append(staged(_search_block(spark, vectors, rows, k)))  # written once each
            rows = []
    if rows or not blocks:
        blocks.append(_search_block(spark, vectors, rows, k))
    return reduce(DataFrame.union, blocks)


def _search_block(spark, vectors: DataFrame, rows: list, k: int) -> DataFrame:
    schema = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], schema)
    block, n = _Block(rows, k), len(rows)
    low, high, want = np.zeros(n, object), np.zeros(n, object), np.full(n, k)  # want: which score inside the interval is sought
    norm = _reach(vectors)
    for w, (at, ids, q) in block.by_width.items():
        for i in range(len(ids)):  # Cauchy and Schwarz bound every score
            reach = int(np.sqrt(float((q[i].astype(float) ** 2).sum())) * norm.get(w, 0.0) * (1 + 1e-9)) + 1
            low[at + i], high[at + i] = -reach, reach + 1
    found = np.ones(n, bool)
    while any(found & (high - low > 1)):
        width = np.array([max(1, -(-(h - lo) // BINS)) for lo, h in zip(low, high)], object)
        lo64, wd64 = np.array([max(_LONG[0], x) for x in low], np.int64), np.array(width, np.int64)
        hi64 = np.array([min(_LONG[1], x) for x in high], np.int64)

        def count(batches: Iterator[pd.DataFrame], lo64=lo64, wd64=wd64, hi64=hi64) -> Iterator[pd.DataFrame]:
            # of each query's scores inside its interval only the task's k highest can decide where the kth lies
            tops: dict[int, np.ndarray] = {}
            for b in batches:
                for at, _, s, ok in block.pairs(b):
                    m = s.shape[1]
                    inside = ok & (s >= lo64[at : at + m]) & (s < hi64[at : at + m])
                    tops[at] = _merged(tops.get(at), np.where(inside, s, _LONG[0]), k)
            for at, t in tops.items():
                i, j = np.nonzero(t > _LONG[0])
                bins = (t[i, j] - lo64[at + j]) // wd64[at + j]
                yield pd.DataFrame({"query": at + j, "bin": bins, "n": 1}).groupby(["query", "bin"], as_index=False)["n"].sum()

        counted = vectors.mapInPandas(count, "query int, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # the bins from the top until k scores are reached: k rows a query at most come to the driver
        above = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        picked = counted.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        wanted = spark.createDataFrame([(i, int(want[i])) for i in range(n)], "query int, want long")
        at_k = picked.join(F.broadcast(wanted), "query").filter("above < want and (above + n >= want)").select("query", "bin", "above").collect()
        found[:] = False
        for q, b, a in at_k:
            found[q] = True
            low[q], want[q] = low[q] + b * width[q], want[q] - a
            high[q] = min(high[q], low[q] + width[q])
        for q in np.flatnonzero(~found):  # fewer than k candidates: every score counts
            low[q], high[q] = _LONG[0] + 1, _LONG[0] + 2
    kth = np.array([int(x) for x in low], np.int64)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ties: dict[int, np.ndarray] = {}
        for b in batches:
            for at, c_ids, s, ok in block.pairs(b):
                m = s.shape[1]
                i, j = np.nonzero(ok & (s > kth[at : at + m]))
                if len(i):
                    yield pd.DataFrame({"query_id": block.ids[at + j], "query": at + j, "vec_id": c_ids[i], "score": s[i, j]})
                i, j = np.nonzero(ok & (s == kth[at : at + m]))
                for q in np.unique(j):
                    own = np.concatenate([ties.get(at + q, np.zeros(0, np.int64)), c_ids[i[j == q]]])
                    ties[at + q] = np.sort(own)[:k]
        for q, ids in ties.items():
            yield pd.DataFrame({"query_id": block.ids[q], "query": q, "vec_id": ids, "score": kth[q]})

    kept = vectors.mapInPandas(keep, "query_id long, query int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(vectors: DataFrame) -> dict[int, float]:
    """The greatest length of a vector, for each number of components."""

    def longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, float] = {}
        for b in batches:
            for w, own in b.groupby("width"):
                best[w] = max(best.get(w, 0.0), float(np.sqrt((_matrix(list(own["q"]), w).astype(float) ** 2).sum(1)).max()))
        yield pd.DataFrame({"width": list(best), "reach": list(best.values())})

    return {r[0]: r[1] for r in vectors.mapInPandas(longest, "width int, reach double").groupBy("width").agg(F.max("reach")).collect()}


def query(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    q = staged(quantised(vectors))
    return search(q, q.filter(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
