"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts.

Tokens are the words of a text, A-Z lower-cased, and one end; the end is also the history of the first token. A bigram seen r
times has the probability d(r) r / c(h), where d is the Good-Turing discount up to ``CUT`` and 1 beyond; what the discounts
free goes to the words not seen after h in proportion to the unigram model, whose own discounts leave a share for the
unknown word. The backoff weights are exact: each history's probabilities sum to one over the known words and the unknown one.
Where the counts allow no Good-Turing discount (a count of counts is zero, or a ratio leaves (0, 1)), absolute discounting
takes its place, and a history or the unigrams that would keep nothing back keep 1 / (count + 1).

Everything that is gathered covers all training texts and stays in tables. Documents are packed into blocks of about
``BLOCK_TOKENS`` tokens. A block asks word buckets for ids and counts, then bigram buckets for counts and for what its
histories' weights need, and evaluates its tokens. Requests are distinct and pre-aggregated within a block, so a frequent word
costs a row a block at most; histories frequent enough to fill a bucket are dealt out by both words, and their sums are
joined afterwards (there are at most four a bucket of them).

A null text counts as empty: it has one token, the end. Rows that repeat are scored, and counted, once each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import column, crc_mod, slices, staged, trim, word_blocks

BLOCK_TOKENS, CUT, END = 1_000_000, 5, b" "
#: Histories at most whose sums are joined on the driver.
HOT = 80_000


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        v = self[word] = len(self)
        return v


def _pack(x: np.ndarray) -> bytes:
    """Compressed, in planes of bytes."""
    return _packs(x)


def _unpack(b: bytes) -> np.ndarray:
    return _unpacks(b)[0]


def _packs(*xs: np.ndarray) -> bytes:
    """Arrays in one frame: their types and lengths, and the planes of their bytes compressed together."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in xs)
    return struct.pack(f"<B{len(xs)}c{len(xs)}I", len(xs), *(x.dtype.char.encode() for x in xs), *map(len, xs)) + zstandard.compress(planes, 1)


def _unpacks(b: bytes) -> list[np.ndarray]:
    n = b[0]
    kinds = [np.dtype(chr(c)) for c in b[1 : 1 + n]]
    sizes = struct.unpack_from(f"<{n}I", b, 1 + n)
    raw, at, out = np.frombuffer(zstandard.decompress(b[1 + 5 * n :]), np.uint8), 0, []
    for d, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + s * d.itemsize].reshape(d.itemsize, -1).T).view(d).reshape(-1) if s else np.zeros(0, d))
        at += s * d.itemsize
    return out


def _small(x: np.ndarray) -> np.ndarray:
    m = int(x.max(initial=0))
    return x.astype(np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32 if m < 1 << 32 else np.uint64)


# ---- blocks of documents

_BLOCK = "block string, rows binary, words binary, tokens binary, lengths binary"


def blocks(documents: DataFrame, mod: int = 7, held: int = 2, size: int = BLOCK_TOKENS) -> DataFrame:
    """Documents packed with a vocabulary of their own: ids, nulls and folds, token numbers, their lengths with the end, and the words by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        vocab, ids, out, tokens, lengths = _Vocabulary({END: 0}), [], [], [], []

        def row() -> pa.RecordBatch:
            rows = _packs(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array(out, np.uint8))
            cells = (f"{part}-{n}", rows, zstandard.compress(b"\n".join(vocab), 1), _pack(_small(np.concatenate(tokens))), _pack(np.array(lengths, np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["block", "rows", "words", "tokens", "lengths"])

        for whole in batches:
            for b in slices(whole):
                for i, h, t in zip(*(column(b, c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                    own = [np.fromiter(map(vocab.__getitem__, ws), np.uint32, len(ws)) for ws in word_blocks(t)]
                    own.append(np.zeros(1, np.uint32))
                    tokens += own
                    lengths.append(sum(map(len, own)))
                    ids.append(i)
                    out.append(h)
                    total += lengths[-1]
                    if total >= size:
                        yield row()
                        n, total = n + 1, 0
                        vocab, ids, out, tokens, lengths = _Vocabulary({END: 0}), [], [], [], []
        if ids:
            yield row()
        vocab, tokens = None, None
        trim()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", mod) == held).alias("held_out"), "text")
    return docs.mapInArrow(run, _BLOCK)


class _Read:
    """A block's row, opened."""

    def __init__(self, r):
        self.ids, self.null, held = _unpacks(bytes(r.rows))
        self.held = held > 0
        self.words = zstandard.decompress(r.words).split(b"\n")
        self.tokens = _unpack(bytes(r.tokens)).astype(np.int64)
        self.lengths = _unpack(bytes(r.lengths)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def word_buckets(self, n: int) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)) % np.uint64(n)


# ---- words


def _ask_words(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = _Read(r)
                bucket, count = x.word_buckets(n), np.bincount(x.tokens[x.train], minlength=len(x.words))
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[k] : cuts[k + 1]]
                    rows.append((int(k), r.block, zstandard.compress(b"\n".join([x.words[i] for i in own]), 1), _pack(_small(count[own]))))
                yield pd.DataFrame(rows, columns=["bucket", "block", "words", "counts"])
                del x, rows
        trim()

    return run


_ANSWER = "kind string, block string, bucket int, blob binary"


def _answer_words(n: int):
    """Ids (the more frequent the smaller, dense over all buckets) and counts for every block that asked, and the bucket's statistics."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, vocab = int(pdf["bucket"].iloc[0]), _Vocabulary()
        asked = [(r.block, np.array(list(map(vocab.__getitem__, zstandard.decompress(r.words).split(b"\n")))), _unpack(r.counts)) for r in pdf.itertuples()]
        count = np.zeros(len(vocab), np.int64)
        for _, at, c in asked:
            count[at] += c
        rank = np.empty(len(vocab), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(vocab))
        rows = [("word", block, bucket, _packs(_small(rank[at] * n + bucket), _small(count[at]))) for block, at, _ in asked]
        rows.append(("stats", "", bucket, np.array([count.sum(), (count > 0).sum(), *((count == r).sum() for r in range(1, CUT + 2))], "<i8").tobytes()))
        return pd.DataFrame(rows, columns=["kind", "block", "bucket", "blob"])

    return run


def _stats(answers: DataFrame, kind: str = "stats") -> np.ndarray:
    """The sum of the buckets' statistics: a few numbers, added up by an aggregate over their bytes' values."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = sum((np.frombuffer(x, "<i8") for x in b["blob"]), np.zeros(1, np.int64))
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = answers.filter(F.col("kind") == kind).select("blob").mapInPandas(add, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.i for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.i] = r.v
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..CUT) from the counts of counts n[0] = n_1 ... n[CUT] = n_(CUT + 1); d(0) is unused."""
    n = n.astype(float)
    out = np.ones(CUT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.arange(1, CUT + 1)
        again = (r + 1) * n[1:] / n[:-1]
        common = (CUT + 1) * n[CUT] / n[0]
        d = (again / r - common) / (1 - common)
    if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
        out[1:] = d
    else:
        a = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
        out[1:] = (r - a) / r
    return out


class Unigrams:
    def __init__(self, stats: np.ndarray):
        self.total, self.known = (int(stats[0]), int(stats[1])) if len(stats) else (0, 0)
        self.d = discounts(stats[2:] if len(stats) else np.zeros(CUT + 1, np.int64))
        seen = self.total - sum((1 - self.d[r]) * r * int(stats[1 + r]) for r in range(1, CUT + 1)) if self.total else 0.0
        self.unknown = max(1 - seen / self.total, 1 / (self.total + 1)) if self.total else 1.0
        self.scale = (1 - self.unknown) / seen if seen else 0.0

    def p(self, count: np.ndarray) -> np.ndarray:
        """The probability of a word by its count; a count of 0 is the unknown word."""
        c = count.astype(float)
        return np.where(count > 0, self.d[np.minimum(count, CUT)] ** (count <= CUT) * c * self.scale, self.unknown)


# ---- bigrams


class _Bigrams:
    """A block's distinct bigrams, in buckets: the same whenever it is built from the block and its words' answers."""

    def __init__(self, x: _Read, words: pd.DataFrame, n_words: int, n: int, hot: float):
        wid, self.count = np.zeros(len(x.words), np.int64), np.zeros(len(x.words), np.int64)
        order, at = np.argsort(x.word_buckets(n_words), kind="stable"), 0
        for r in words.sort_values("bucket").itertuples():
            ids, count = _unpacks(r.blob)
            own = order[at : at + len(ids)]
            wid[own], self.count[own] = ids, count
            at += len(ids)
        self.x, self.wid, self.hot = x, wid, self.count > hot
        before = np.r_[0, x.tokens[:-1]]
        before[np.r_[0, np.cumsum(x.lengths)[:-1]].astype(np.int64)] = 0
        v = len(x.words)
        self.keys, self.of = np.unique(before * v + x.tokens, return_inverse=True)
        self.h, self.w = np.divmod(self.keys, v)
        self.r = np.bincount(self.of[x.train], minlength=len(self.keys))
        mix = (wid[self.h].astype(np.uint64) + np.where(self.hot[self.h], wid[self.w].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.bucket = ((mix >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        self.order = np.lexsort((wid[self.w], wid[self.h], self.bucket))
        self.cuts = np.searchsorted(self.bucket[self.order], np.arange(n + 1))

    def asked(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in np.flatnonzero(np.diff(self.cuts)):
            yield int(k), self.order[self.cuts[k] : self.cuts[k + 1]]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array the first places of equal values, and for each place which group it is in."""
    new = np.r_[True, h[1:] != h[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _ask_bigrams(n_words: int, n: int, hot: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.itertuples():
            b = _Bigrams(_Read(r), right, n_words, n, hot)
            for k, own in b.asked():
                h, w = b.wid[b.h[own]], b.wid[b.w[own]]
                first, _ = _groups(h)
                ws, one = np.unique(w, return_index=True)
                blob = _packs(_small(np.diff(h[first], prepend=0)), _small(np.diff(np.r_[first, len(h)])), _small(w), _small(b.r[own]), _small(b.count[b.w[own]][one]), b.hot[b.h[own][first]].astype(np.uint8))
                rows.append((k, r.block, blob))
        return pd.DataFrame(rows, columns=["bucket", "block", "blob"])

    return run


def _answer_bigrams(unigrams: Unigrams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, asked, hs, ws, rs = int(pdf["bucket"].iloc[0]), [], [], [], []
        w_ids, w_counts, hot_ids = [], [], []
        for r in pdf.itertuples():
            dh, sizes, w, count, c, hot = _unpacks(r.blob)
            own = np.cumsum(dh.astype(np.int64))
            hs.append(np.repeat(own, sizes))
            ws.append(w.astype(np.int64))
            rs.append(count.astype(np.int64))
            w_ids.append(np.unique(ws[-1]))
            w_counts.append(c.astype(np.int64))
            hot_ids.append(own[hot > 0])
            asked.append((r.block, len(w), own))
        h_all, h_at = np.unique(np.concatenate(hs), return_inverse=True)
        w_all, one = np.unique(np.concatenate(w_ids), return_index=True)
        w_p = unigrams.p(np.concatenate(w_counts)[one])
        w_at = np.searchsorted(w_all, np.concatenate(ws))
        keys, of = np.unique(h_at * len(w_all) + w_at, return_inverse=True)
        r = np.bincount(of, np.concatenate(rs), len(keys)).astype(np.int64)
        seen, kh = r > 0, keys // len(w_all)
        # what each history's weight needs: how many followers of each discounted count, the sum of the others, their unigram mass
        table = np.zeros((len(h_all), CUT + 1), np.int64)
        np.add.at(table, (kh[seen], np.minimum(r[seen], CUT + 1) - 1), np.where(r[seen] > CUT, r[seen], 1))
        mass = np.bincount(kh[seen], w_p[keys[seen] % len(w_all)], len(h_all))
        rows, at = [], 0
        for block, n, own in asked:
            k = np.searchsorted(h_all, own)
            rows.append(("bigram", block, bucket, _packs(_small(r[of[at : at + n]]), *(_small(table[k, i]) for i in range(CUT + 1)), mass[k])))
            at += n
        rows.append(("counts", "", bucket, np.array([(r == i).sum() for i in range(1, CUT + 2)], "<i8").tobytes()))
        if len(hot := np.unique(np.concatenate(hot_ids))):
            k = np.searchsorted(h_all, hot)
            rows.append(("hot", "", bucket, _packs(hot, table[k].reshape(-1), mass[k])))
        return pd.DataFrame(rows, columns=["kind", "block", "bucket", "blob"])

    return run


def _hot_sums(answers: DataFrame) -> dict[int, np.ndarray]:
    """The frequent histories' sums over their buckets; at most four a bucket."""

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["blob"]:
                ids, table, mass = _unpacks(x)
                yield pd.DataFrame({"h": ids, **{f"t{i}": table.reshape(-1, CUT + 1)[:, i] for i in range(CUT + 1)}, "mass": mass})

    cols = [f"t{i}" for i in range(CUT + 1)]
    rows = answers.filter("kind = 'hot'").select("blob").mapInPandas(open_, "h long, " + ", ".join(f"{c} long" for c in cols) + ", mass double").groupBy("h").agg(*(F.sum(c).alias(c) for c in cols), F.sum("mass").alias("mass")).collect()
    return {r.h: np.array([*(float(r[c]) for c in cols), r.mass]) for r in rows}


def _evaluate(unigrams: Unigrams, d: np.ndarray, hot_sums: dict[int, np.ndarray], n_words: int, n: int, hot: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            x = _Read(row)
            b = _Bigrams(x, right[right["kind"] == "word"], n_words, n, hot)
            answers = {r.bucket: r.blob for r in right[right["kind"] == "bigram"].itertuples()}
            r, stat = np.zeros(len(b.keys), np.int64), np.zeros((len(x.words), CUT + 2))
            for k, own in b.asked():
                got = _unpacks(answers[k])
                r[own] = got[0]
                first, _ = _groups(b.wid[b.h[own]])
                stat[b.h[own][first]] = np.stack([g.astype(float) for g in got[1:]], 1)
            for i in np.flatnonzero(b.hot):
                if (s := hot_sums.get(int(b.wid[i]))) is not None:
                    stat[i] = s
            c = b.count.astype(float)
            kept = stat[:, :CUT] @ (d[1:] * np.arange(1, CUT + 1)) + stat[:, CUT]
            with np.errstate(divide="ignore", invalid="ignore"):
                left_over = np.maximum(1 - kept / c, 1 / (c + 1))
                scale = (1 - left_over) / kept
                alpha = np.where(b.count > 0, left_over / (1 - stat[:, CUT + 1]), 1.0)
                p = np.where(r > 0, d[np.minimum(r, CUT)] ** (r <= CUT) * r * scale[b.h], alpha[b.h] * unigrams.p(b.count)[b.w])
            base = np.log10((b.count + 1) / (unigrams.total + unigrams.known + 1))
            sums = lambda v: np.bincount(x.doc, v, len(x.lengths))
            out.append(pd.DataFrame({"doc_id": pd.arrays.IntegerArray(x.ids.astype(np.int64), x.null > 0), "held_out": x.held, "n_tokens": x.lengths, "n_known": sums((b.count > 0)[x.tokens]).astype(np.int64), "train_tokens": unigrams.total, "base_score": sums(base[x.tokens]), "score": sums(np.log10(p)[b.of])}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(documents: DataFrame, mod: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document, from a model of the documents whose crc32(doc_id) mod `mod` is not `held`."""
    own = staged(blocks(documents, mod, held, block_tokens))
    n = max(64, 2 * own.count())  # buckets grow with the blocks, so that what one gathers doesn't
    words = staged(own.mapInPandas(_ask_words(n), "bucket int, block string, words binary, counts binary").groupBy("bucket").applyInPandas(_answer_words(n), _ANSWER))
    unigrams = Unigrams(_stats(words))
    hot = unigrams.total / min(4 * n, HOT)
    answers = words.filter("kind = 'word'")
    asked = own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_ask_bigrams(n, n, hot), "bucket int, block string, blob binary")
    bigrams = staged(asked.groupBy("bucket").applyInPandas(_answer_bigrams(unigrams), _ANSWER))
    counts = _stats(bigrams, "counts")
    d = discounts(counts if len(counts) else np.zeros(CUT + 1, np.int64))
    both = answers.union(bigrams.filter("kind = 'bigram'"))
    return own.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(_evaluate(unigrams, d, _hot_sums(bigrams), n, n, hot), _SCORES)


def query(documents: DataFrame) -> DataFrame:
    return scores(documents)
