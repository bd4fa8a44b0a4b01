"""SentencePiece encoding and decoding, with sampled segmentations without replacement.

Encoding is that of the given model; texts are cut where no piece of the model can reach across (before a run of spaces and
around newlines), so that equal chunks are encoded once. Decoding gives back the text.

Sampling draws from the lattice of all segmentations of a text into pieces. A piece weighs 1 / (rank + 2), a character
outside the vocabulary one byte piece a byte; backward sums make every lattice node a choice with known probabilities. The k
samples are a perturbed A* search: the root carries a Gumbel value, the best path below a node inherits it, and each
set of paths that leaves the best path at one node has its own Gumbel, truncated by the one above. Since the best value
of such a set is known exactly, it is also the search's bound: the next sample is the best set's best path, and no two are
the same. A sample's inclusion probability is 1 - exp(-exp(log p - kappa)), kappa being the best value left unopened.

All draws are hashes of (doc_id, sample, node), so a row's samples don't depend on its batch or task. A null or empty text has
no pieces and one empty sample of probability 1; where a text has fewer than k segmentations it has as many samples.
Map-only; whole texts.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import appended, fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, NODES = 3, 2_000_000
_CHUNK = re.compile(r" *[^ \n]+|\n| +(?=\n|$)")
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)}
        pieces = [(self.sp.id_to_piece(i), i) for i in range(n) if i not in special]
        self.longest = max(len(p) for p, _ in pieces)
        weight = -np.log(np.arange(n) + 2.0)
        self.byte_weight = float(-np.log(n + 2.0))
        # by length: the keys of all beginnings of pieces, and the id of each (-1: not a piece itself) with its weight
        begins: list[dict[int, int]] = [{} for _ in range(self.longest)]
        for p, i in pieces:
            h = 0
            for l, c in enumerate(p):
                h = (h + ord(c) * pow(_MUL, l + 1, 1 << 64)) & _MASK
                begins[l].setdefault(h, -1)
            begins[-1 + len(p)][h] = i
        self.tables = []
        for b in begins:
            own = sorted(b.items())
            ids = np.array([i for _, i in own], np.int32)
            self.tables.append((np.array([h for h, _ in own], np.uint64), ids, weight[ids]))
        self.lattice = Lattice(self)

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks inside a text, each kind of chunk in one call; what stands before a chunk only keeps it from getting the leading space."""
        plain = [c[1:] if c[0] == " " and c != " " else "\n" + c for c in chunks]
        return [x if c[0] == " " and c != " " else x[2:] for c, x in zip(chunks, self.sp.encode(plain))]

    def encode(self, text: str) -> list[int]:
        words, _ = self.lattice.words([text])
        return self.lattice.encoded(words).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seed(key: np.ndarray, *parts) -> np.ndarray:
    for p in parts:
        key = _mix(key + np.uint64(_MUL) * (np.atleast_1d(p).astype(np.uint64) + np.uint64(1)))
    return key


def _unit(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    return _unit(_seed(key, *parts))


def _joined(parts: np.ndarray, first: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs first[i] : first[i + 1] of parts, for every i of pick, end to end."""
    begin, size = first[pick], first[pick + 1] - first[pick]
    stop = np.cumsum(size)
    return parts[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)]


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype, *values):
        self.a, self.n = np.empty(1 << 12, dtype), 0
        self.add(np.array(values, dtype))

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.empty(self.n // 2 + len(x), self.a.dtype)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


class _Index(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = out = len(self)
        return out


class Lattice:
    """The lattices of many distinct chunks, kept from one slice of texts to the next.

    A node is a character's position; its edges, the longest first, are the pieces that may follow, with their log probabilities and
    cumulated probabilities. A lattice that has outgrown its number of nodes is begun anew, which changes no result.
    """

    def __init__(self, codec: Codec):
        self.codec, self.index, self.done = codec, _Index(), 0
        self.nodes: int | None = None  # None: NODES
        self.start, self.points, self.first = _Column(np.int64), _Column(np.uint32), _Column(np.int64, 0)
        self.own, self.own_first = _Column(np.int32), _Column(np.int64, 0)
        self.size, self.last, self.node = _Column(np.int8), _Column(bool), _Column(np.int32)
        self.ids, self.logp, self.cum = _Column(np.int32), _Column(float), _Column(float)

    def clear(self) -> None:
        """Forgets all chunks; the columns keep their memory, and those of offsets their first zero."""
        self.index, self.done = _Index(), 0
        for c in (self.start, self.points, self.own, self.size, self.last, self.node, self.ids, self.logp, self.cum):
            c.n = 0
        self.first.n = self.own_first.n = 1

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' chunks as numbers in the lattice, and where each text begins; a text's first chunk has the model's leading space."""
        if self.points.n > (NODES if self.nodes is None else self.nodes):
            self.clear()
        found = [_CHUNK.findall(t or "") for t in texts]
        for f in found:
            if f:
                f[0] = " " + f[0]
        begin = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        words = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(begin[-1]))
        if len(self.index) > self.done:
            self._add(list(itertools.islice(self.index, self.done, None)))
            self.done = len(self.index)
        return words, begin

    def encoded(self, words: np.ndarray) -> np.ndarray:
        return _joined(self.own.a, self.own_first.a, words)

    def _add(self, chunks: list[str]) -> None:
        codec, base = self.codec, self.points.n
        own = codec.chunk_ids(chunks)
        self.own.add(np.fromiter(itertools.chain.from_iterable(own), np.int32))
        self.own_first.add(self.own_first.a[self.own_first.n - 1] + np.cumsum([len(x) for x in own]))
        points = np.frombuffer("".join(chunks).replace(" ", "▁").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(c) for c in chunks])
        start = np.cumsum(sizes) - sizes
        n = len(points)
        left = np.repeat(start + sizes, sizes) - np.arange(n)
        at, size, ids, score = [], [], [], []
        bare = np.ones(n, bool)  # characters without a piece of their own: their bytes
        h, power, ok = np.zeros(n, np.uint64), 1, np.arange(n)
        for l, (keys, piece, weight) in enumerate(codec.tables):
            if l:
                go = left[ok] > l
                ok, h = ok[go], h[go]
            if not len(ok):
                break
            power = power * _MUL & _MASK
            h = h + points[ok + l] * np.uint64(power)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            go = keys[k] == h
            ok, h, k = ok[go], h[go], k[go]
            whole = piece[k] >= 0
            at.append(ok[whole])
            ids.append(piece[k[whole]])
            score.append(weight[k[whole]])
            size.append(np.full(len(at[-1]), l + 1, np.int8))
            if l == 0:
                bare[at[-1]] = False
        bare = np.flatnonzero(bare)
        width = 1 + (points[bare] > 0x7F).astype(int) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
        one = np.full(len(bare), -1, np.int32)
        one[width == 1] = np.array(codec.bytes, np.int32)[points[bare[width == 1]].astype(np.int64)]
        at, size, ids, score = (np.concatenate(x) for x in ([*at[::-1], bare], [*size[::-1], np.ones(len(bare), np.int8)], [*ids[::-1], one], [*score[::-1], width * codec.byte_weight]))
        order = np.argsort(at, kind="stable")
        at, size, ids, score = at[order], size[order], ids[order], score[order]
        count = np.bincount(at, minlength=n)
        stop = np.cumsum(count)
        # backward sums, over nodes at the same distance from their chunk's end
        far = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        edge = _joined(np.arange(len(at)), np.r_[0, stop], far)
        a_, s_, c_ = at[edge], size[edge].astype(np.int64), score[edge]
        inner = s_ < left[a_]
        lead = np.cumsum(count[far]) - count[far]
        cut = np.searchsorted(left[far], np.arange(1, int(sizes.max(initial=0)) + 2))
        ends = np.r_[lead, len(at)]
        beta = np.zeros(n + 1)
        for x, y in zip(cut, cut[1:]):
            if x == y:
                continue
            a, b = ends[x], ends[y]
            c = c_[a:b] + np.where(inner[a:b], beta[a_[a:b] + s_[a:b]], 0.0)
            begin, many = lead[x:y] - a, count[far[x:y]]
            top = np.maximum.reduceat(c, begin)
            beta[far[x:y]] = total = top + np.log(np.add.reduceat(np.exp(c - np.repeat(top, many)), begin))
            c_[a:b] = c - np.repeat(total, many)
        score[edge] = c_
        cum, more, r = np.exp(score), np.flatnonzero(count > 1), 1
        while len(more):  # node by node, so that no sum depends on what else is in the lattice
            e = stop[more] - count[more] + r
            cum[e] += cum[e - 1]
            r += 1
            more = more[count[more] > r]
        cum[stop - 1] = np.inf
        self.start.add(base + start)
        self.points.add(points.astype(np.uint32))
        self.first.add(self.first.a[self.first.n - 1] + stop)
        self.size.add(size)
        self.last.add(size == left[at])
        self.node.add((base + at).astype(np.int32))
        self.ids.add(ids)
        self.logp.add(score)
        self.cum.add(cum)

    def walk(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Free choices from nodes to the ends of their chunks: the edges, and how many each walk took. `seed` is the hash at each node."""
        first, cum, size, last = self.first.a, self.cum.a, self.size.a, self.last.a
        steps, walk, count = [], np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(walk):
            u, e = _unit(_mix(seed)), first[at]
            on = np.flatnonzero(cum[e] <= u)
            while len(on):
                e[on] += 1
                on = on[cum[e[on]] <= u[on]]
            steps.append((walk, e))
            count[walk] += 1
            go = np.flatnonzero(~last[e])
            step = size[e[go]]
            walk, at, seed = walk[go], at[go] + step, seed[go] + np.uint64(_MUL) * step.astype(np.uint64)
        where = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for i, (w, e) in enumerate(steps):
            out[where[w] + i] = e
        return out, count

    def expand(self, edges: np.ndarray) -> np.ndarray:
        """The ids of pieces; a character without a piece gives the ids of its bytes."""
        ids = self.ids.a[edges]
        if (ids >= 0).all():
            return ids
        out: list[int] = []
        for i, p in zip(ids.tolist(), self.points.a[self.node.a[edges]].tolist()):
            out += [i] if i >= 0 else [self.codec.bytes[b] for b in chr(p).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)


#: No logarithm of an exponential draw made from 53 bits is lower.
LEAST_LOG_DRAW = -37.5


def _leaves(lat: Lattice, edges: list[np.ndarray], skip: np.ndarray, bound: np.ndarray, key: np.ndarray, j: int, need: int, n: int = 512) -> list[list[tuple[float, int]]]:
    """For each path the `need` best sets that leave it at one of its nodes from `skip` on: (value, node).

    A set's log mass is at most that of the path before its node, which only falls, and its value falls with the logarithm of its
    draw less its log mass. Where no draw could bring a later node among the best, the look ends; other paths are looked at further.
    """
    wide = max(need, min(n, max(map(len, edges))))
    lp = np.zeros((len(edges), wide))
    for row, e in zip(lp, edges):
        row[: len(e)] = lat.logp.a[e[:wide]]
    at, run = np.arange(wide), np.cumsum(lp, 1)
    with np.errstate(divide="ignore"):
        mass = run - lp + np.log(-np.expm1(np.minimum(lp, 0.0)))
    late = np.log(-np.log(_uniform(_seed(key, j + 1)[:, None], at, 77))) - mass
    late[at < skip[:, None]] = np.inf
    best = np.argpartition(late, need - 1, 1)[:, :need]
    value = np.take_along_axis(late, best, 1)
    open_ = np.flatnonzero((np.array([len(e) for e in edges]) > wide) & (value.max(1) >= LEAST_LOG_DRAW - run[:, -1]))
    out = [[(-v, i) for v, i, w in zip(vs, ns, ls) if w < np.inf] for vs, ns, ls in zip(np.logaddexp(-bound[:, None], value).tolist(), best.tolist(), value.tolist())]
    if len(open_):
        for i, found in zip(open_, _leaves(lat, [edges[i] for i in open_], skip[open_], bound[open_], key[open_], j, need, n * 4)):
            out[i] = found
    return out


def _logaddexp(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def sample(codec: Codec, texts: list[str | None], keys: list[int], k: int = SAMPLES) -> list[list[tuple[list[int], float, float]]]:
    """For each text up to k distinct segmentations, best perturbed value first: (ids, log p, log inclusion)."""
    return _sample(codec.lattice, *codec.lattice.words(texts), keys, k)


def _sample(lat: Lattice, words: np.ndarray, begin: np.ndarray, keys: list[int], k: int) -> list[list[tuple[list[int], float, float]]]:
    count = np.diff(begin)
    ordinal = np.arange(len(words)) - np.repeat(begin[:-1], count)
    key = np.array([k_ & _MASK for k_ in keys], np.uint64)
    first, size, last, node, logp = lat.first.a, lat.size.a, lat.last.a, lat.node.a, lat.logp.a
    # per text: the bound of its search, its paths, and the unopened sets (value, sample, node, excluded edges)
    bounds = dict(zip(np.flatnonzero(count).tolist(), (-np.log(-np.log(_uniform(key, 0))))[count > 0].tolist()))
    open_: list[list[tuple]] = [[] for _ in keys]
    paths: list[list[np.ndarray]] = [[] for _ in keys]
    head = {d: (np.zeros(0, np.int32), 0, 0) for d in bounds}  # the part that a text's next path has already, and where it goes on: chunk, node (0: its first)
    for j in range(k):
        if not bounds:
            break
        ds = list(bounds)
        rest = np.concatenate([np.arange(head[d][1], begin[d + 1] - begin[d]) + begin[d] for d in ds])
        at = lat.start.a[words[rest]]
        many = np.array([begin[d + 1] - begin[d] - head[d][1] for d in ds])
        lead = np.cumsum(many) - many
        seed = _seed(np.repeat(_seed(key[ds], j), many), ordinal[rest])
        for i, d in enumerate(ds):
            if head[d][2]:
                at[lead[i]] = head[d][2]
        seed += np.uint64(_MUL) * (at - lat.start.a[words[rest]] + 1).astype(np.uint64)
        edges, took = lat.walk(at, seed)
        stop = np.r_[0, np.cumsum(took)][lead + many]
        whole = [np.concatenate([head[d][0], edges[a:b]]) for d, a, b in zip(ds, np.r_[0, stop[:-1]], stop)]
        # nodes before the branch belong to sets that are open already
        skip = np.array([len(head[d][0]) for d in ds])
        for d, path, found in zip(ds, whole, _leaves(lat, whole, skip, np.array([bounds[d] for d in ds]), key[ds], j, k - j)):
            paths[d].append(path)
            open_[d] += [(v, j, n, (int(path[n]),)) for v, n in found]
        if j == k - 1:
            break
        ds = [d for d in ds if open_[d]]
        bounds = {d: bounds[d] for d in ds}
        if not ds:
            break
        for d in ds:
            open_[d].sort()
        picked = [open_[d].pop() for d in ds]
        branch = _seed(key[ds], j + 1, np.array([x[2] for x in picked]))
        draws, kept_open = _unit(_seed(branch, 99)).tolist(), np.log(-np.log(_unit(_seed(branch, 55)))).tolist()
        for d, (g, i, n, out), u, e1 in zip(ds, picked, draws, kept_open):
            old = paths[d][i]
            p = int(node[old[n]])
            own, to = int(first[p]), int(first[p + 1])
            prob = np.exp(logp[own:to])
            prob[np.array(out) - own] = 0.0
            run = np.cumsum(prob)
            total = float(run[-1])
            bl = min(int(np.searchsorted(run, u * total, side="right")), to - own - 1)
            while prob[bl] == 0.0:
                bl -= 1
            edge = own + bl
            left = total - float(prob[bl])
            if left > 1e-15:  # what else may follow at this node stays open
                mass_left = float(logp[old[:n]].sum()) + math.log(left)
                open_[d].append((-_logaddexp(-g, e1 - mass_left), i, n, (*out, edge)))
            bounds[d] = g
            chunk = int(np.count_nonzero(last[old[:n]]))
            head[d] = (np.append(old[:n], np.int32(edge)), chunk + 1, 0) if last[edge] else (np.append(old[:n], np.int32(edge)), chunk, p + int(size[edge]))
    result = []
    for d in range(len(keys)):
        kappa = max((x[0] for x in open_[d]), default=-np.inf)
        rows = []
        for edges in paths[d]:
            lp = float(logp[edges].sum())
            x = lp - kappa
            rows.append((lat.expand(edges), lp, 0.0 if x > 700 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x))
        result.append(rows or [([], 0.0, 0.0)])
    return result


def digest(ids: list[int] | np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.array(ids, "<i4").tobytes()) - (1 << 63)


_SAMPLES = "array<struct<rank:int,n_tokens:int,log_prob:double,log_inclusion:double,{}>>"


def encoded(documents: DataFrame, model: str = MODEL, k: int = SAMPLES, ids: bool = True, nodes: int = NODES, size: int = 500_000) -> DataFrame:
    """documents with n_tokens, the model's ids, whether decoding gives back the text, and k sampled segmentations.

    With ids=False the ids are replaced by their digests. nodes: the lattice nodes that a task keeps, and size: the bytes of texts that it samples at once, memory against time;
    no result depends on them. A task's lattice ends with it, since workers live on through other stages.
    """
    new = "n_tokens long, ids array<int>, " if ids else "n_tokens long, ids_digest long, "
    new += "round_trip boolean, samples " + _SAMPLES.format("ids:array<int>" if ids else "digest:bigint")
    what, made = ("ids", lambda x: x) if ids else ("digest", digest)

    def make():
        c = codec(model)
        lattice = Lattice(c)
        lattice.nodes = nodes

        def work(texts: list[str | None], keys: list[str | None]) -> list:
            texts = [t or "" for t in texts]
            words, begin = lattice.words(texts)
            own = [lattice.encoded(words[x:y]) for x, y in zip(begin, begin[1:])]
            drawn = _sample(lattice, words, begin, [xxhash.xxh64_intdigest(i or "") for i in keys], k)
            samples = [[{"rank": r + 1, "n_tokens": len(x), "log_prob": lp, "log_inclusion": li, what: made(x)} for r, (x, lp, li) in enumerate(s)] for s in drawn]
            return [[len(x) for x in own], [made(x) for x in own], [c.sp.decode(o.tolist()) == t for o, t in zip(own, texts)], samples]

        return work

    key = fresh("row_key", documents)
    return appended(documents.drop("n_tokens", "ids", "ids_digest", "round_trip", "samples").withColumn(key, F.col("doc_id").cast("string")), new, make, ("text", key), (key,), size)


def query(documents: DataFrame, model: str = MODEL) -> DataFrame:
    return encoded(documents.select("doc_id", "text"), model, ids=False).drop("text").withColumn("decoded", F.col("round_trip")).drop("round_trip")
