"""Fuzzy line dedup.

Lines are normalised (letters lower-cased, digits as 0, words joined by one space); equal ones collapse to one row that knows its first occurrence.
A line's fingerprint is ``BINS`` numbers: its grams of some bytes (``FULL``) are dealt to as many bins by a hash, and each bin keeps the least of another hash, which a small
edit barely moves; an empty bin takes a number from a bin drawn for it, so that hardly any block hangs on a single gram, which unlike lines share. Lines are candidates
if their fingerprints agree in one of ``BANDS`` blocks of ``ROWS`` numbers. Short lines have few grams, so they have further keys: blocks of minima of shorter
grams (``SETS``), and up to ``TINY`` characters all that is left when one or two characters go, which any two such lines that are similar share. A block that more than ``SMALL`` lines
share is split by further numbers of the fingerprint, and each part stays tied to the least line of the whole, so a hot block whose lines are alike costs rows in
proportion to its lines (see stars). Lines of a hot block that are still in different groups then are all compared, after a bound by the pairs of characters
they share, which leaves no similar pair out (near). All candidates are verified by edit similarity, and the verified links' connected groups keep the
occurrence that comes first by (doc_id, line number).

Fingerprints of majority bits (SimHash) were measured and left: see the README.

Equal lines of every length but zero are one; only lines of ``MIN_CHARS`` characters or more are compared with others that are not equal. Rows that repeat a doc_id and its text are one
document. A null text stays null, an emptied one stays as an empty text, and a null doc_id comes before the others. Very long texts are whole; other columns,
whatever their names, stay as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import stars
from tempora.llm.common import column, fresh, shuffle_parts, slices, staged, trim
from tempora.llm.decontam import masks

MIN_CHARS, SIMILARITY = 5, 0.8
BINS, BANDS, ROWS, SMALL = 64, 16, 4, 32
#: Of fingerprints: the bytes that a line has at least and at most, and the bytes of a gram.
FULL = ((21, 160, 6), (128, 1 << 40, 8))
#: Of further keys: the bytes that a line has at least and at most, the bytes of a gram, and the blocks and the minima in each.
SETS = ((12, 28, 3, 64, 5), (24, 48, 4, 32, 5), (40, 72, 6, 16, 4))
#: Similar lines of so many characters at most are two edits apart, or one up to 9 characters; those of TWO and more may be two edits from a longer one.
TINY, TWO = 14, 8
#: Places that the pairs of characters of a line fall on.
PLACES = 1024
#: Lines of like lengths whose pairs of characters are compared at once.
STRIP = 64
#: Bytes of lines whose fingerprints are made at once.
PART = 400_000
#: Of the batches in which edits are counted: cells of a counterdiagonal, characters, and counterdiagonals between two looks at which pairs are settled.
CELLS, CHARS, STEP = 1 << 16, 1 << 20, 32
#: Pairs that a batch has at least; fewer are counted one by one. Pairs that may be more edits apart are compared by their words first.
FEW, PLAIN = 24, 25
#: Of simhashes() and key_masks(), which the operator itself no longer uses.
RADIUS = 3
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def _plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_DIGITS)


def normalised(line: str) -> str:
    return b" ".join(_plain(line).split()).decode("utf-8", "surrogatepass")


#: For each value of a byte its eight bits, one in each byte of a long: longs add up eight counters at once.
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1).astype(np.uint64)


def line_hashes(norms: list[bytes]) -> np.ndarray:
    """128 bits that stand for each normalised line, as two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, norms)), ">u8").astype("<u8").view("<i8").reshape(-1, 2)


def simhashes(word_lists: list[list[bytes]]) -> np.ndarray:
    """For each list the majority of its different words' hash bits, as longs."""
    sets = [set(ws) for ws in word_lists]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(sets):
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable(sets)), np.uint64, int(sizes.sum()))
    # counters of a byte hold 255 words: longer lines are added up in parts
    parts = -(-sizes // 255)
    first = np.cumsum(sizes) - sizes
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], np.repeat(first, parts) + 255 * nth, axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64)
    if len(ones) > len(sets):
        ones = np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)


def similarity(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - edits / the longer length reaches `least`; equal ends are cut off first, and words that agree in order bound the edits from above."""
    a, b, most = _cut(a, b, least)
    return abs(len(a) - len(b)) <= most and (_soon(a, b, most) or _edits(a, b, most) <= most)


def _cut(a: str, b: str, least: float) -> tuple[str, str, int]:
    """Two strings without their equal ends, and the edits that may be between them."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) <= most:
        n = _common(a, b)
        a, b = a[n:], b[n:]
        if n := _common(a[::-1], b[::-1]):
            a, b = a[:-n], b[:-n]
    return a, b, most


def _soon(a: str, b: str, most: int) -> bool:
    return max(len(a), len(b)) <= most or _by_words(a.split(" "), b.split(" "), most)


def similar(a: list[str], b: list[str], least: float = SIMILARITY, alike: bool = True) -> np.ndarray:
    """similarity() of a[i] and b[i] for all i, with the edits counted in batches; alike: many may be settled by their words."""
    out, open_ = np.zeros(len(a), bool), []
    for i, pair in enumerate(zip(a, b)):
        x, y, most = _cut(*pair, least)
        if abs(len(x) - len(y)) > most:
            continue
        if max(len(x), len(y)) <= most or alike and most > PLAIN and _soon(x, y, most):
            out[i] = True
        else:
            open_.append((i, x, y, most) if len(x) <= len(y) else (i, y, x, most))
    if open_:
        at, x, y, most = zip(*open_)
        out[list(at)] = _within(x, y, np.array(most))
    return out


def _common(a: str, b: str) -> int:
    """The length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _by_words(a: list[str], b: list[str], most: int, reach: int = 4) -> bool:
    """Whether replacing runs of words, each up to the next place where both go on alike, takes at most so many edits."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for d, e in _STEPS[reach]:
            if i + d < len(a) and j + e < len(b) and a[i + d] == b[j + e]:
                break
        else:
            d = e = 1
        cost += max(sum(map(len, a[i : i + d])) + d, sum(map(len, b[j : j + e])) + e) - (d > 0 < e)
        if cost > most:
            return False
        i, j = i + d, j + e
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j) <= most


#: Steps over runs of words, the shortest first; a replaced run keeps the space after it.
_STEPS = {n: sorted(((d, e) for d in range(n + 1) for e in range(n + 1) if d or e), key=lambda x: (max(x), sum(x))) for n in (4,)}


def _edits(a: str, b: str, most: int) -> int:
    """Myers' bit-parallel distance of two whole strings, or more than `most` once that is certain."""
    peq, m = masks(a), len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, left = full, 0, m, len(b)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        score += bool(hp & top) - bool(hn & top)
        left -= 1
        if score - left > most:
            break
        hp = hp << 1 | 1
        vp = (hn << 1 | ~(xv | hp)) & full
        vn = hp & xv
    return score


def _within(a: tuple[str, ...], b: tuple[str, ...], most: np.ndarray) -> np.ndarray:
    """Whether a[i] and the longer b[i] are most[i] edits apart at most; pairs of about the same length and edits make a batch."""
    size = np.fromiter(map(len, b), np.int64, len(b))
    kind = (np.log(most + 32) / np.log(1.5)).astype(np.int64)
    order = np.lexsort((size, kind))
    kind, size, out, at = kind[order], size[order], np.zeros(len(a), bool), 0
    while at < len(order):
        stop = min(at + max(1, min(4096, CELLS // (int(most[order[at]]) // 2 + 1), CHARS // int(size[at]))), int(np.searchsorted(kind, kind[at], "right")))
        stop = at + int(np.searchsorted(size[at:stop], 1.5 * size[at] + 32, "right"))
        own = order[at:stop].tolist()
        if len(own) < FEW or int(most[own].max()) + STEP >= 1 << 16:
            out[own] = [_edits(a[i], b[i], k) <= k for i, k in zip(own, most[own].tolist())]
        else:
            out[own] = _batch([a[i] for i in own], [b[i] for i in own], most[own])
        at = stop
    return out


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of all texts as numbers, of one byte if that is enough to tell them apart."""
    whole = "".join(texts)
    try:
        return np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        there = np.zeros(int(c.max()) + 1, bool)
        there[c] = True
        n = np.count_nonzero(there)
        to = np.zeros(len(there), np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)
        to[there] = np.arange(n)
        return to[c]


def _grid(codes: np.ndarray, sizes: np.ndarray, rows: int, flip: bool) -> np.ndarray:
    """A column of so many rows for each text: its characters from row 1 on, or from the last but one upwards."""
    out = np.zeros((len(sizes), rows), codes.dtype)
    col = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), rows - 1 - col if flip else col] = codes
    return np.ascontiguousarray(out.T)


def _batch(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """_within() for one batch: edit distances of all its pairs, counterdiagonal by counterdiagonal, on the diagonals (places in b less places in a) that so few edits can reach.

    Even and odd diagonals have an array each, whose rows are diagonals and whose columns are pairs; what is more than all of `most` counts as one more. A pair
    goes once it is settled or each of its cells needs too many edits, those to the diagonal of its end included. Numbers are bytes where they fit, else of two bytes.
    """
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    delta, end = n - m, n + m
    spare = (most - delta) // 2
    left, right, last, cap = int(spare.max()), int((delta + spare).max()), int(end.max()), int(most.max()) + 1
    number = np.uint8 if cap + STEP <= 255 else np.uint16
    codes, rows = _codes([*a, *b]), last // 2 + max(left, right) + 3
    if by_xor := number is np.uint16 and codes.itemsize <= 2:  # adding truth values to longer numbers is slow
        codes = codes.astype(np.uint16)
    x, y = _grid(codes[: int(m.sum())], m, rows, True), _grid(codes[int(m.sum()) :], n, rows, False)
    base = left + left % 2 + 2
    many = (base + right) // 2 + 3
    d = [np.full((many, len(a)), cap, number) for _ in range(2)]
    d[0][base // 2] = 0
    bound = [np.clip(most - np.abs(2 * np.arange(many)[:, None] + p - base - delta), 0, cap).astype(number) for p in range(2)]
    of, ends, out = np.arange(len(a)), set(end.tolist()), np.zeros(len(a), bool)
    step, unlike = np.empty((many, len(a)), number), np.empty((many, len(a)), number if by_xor else bool)
    one = np.ones((1, len(a)), number)  # a row: with a plain number numpy is ten times slower
    for s in range(1, last + 1):
        low, high = max(-left, -s), min(right, s)
        low += (s - low) % 2
        c = (high - low) // 2 + 1
        if c > 0:
            p, u = (low + base) % 2, (low + base) // 2
            i, j, o = (s - low) // 2, (s + low) // 2, u - 1 + p
            own, other = d[p][u : u + c], d[1 - p]
            if by_xor:
                np.bitwise_xor(x[rows - 1 - i : rows - 1 - i + c], y[j : j + c], out=unlike[:c])
                own += np.minimum(unlike[:c], one, out=unlike[:c])
            else:
                np.not_equal(x[rows - 1 - i : rows - 1 - i + c], y[j : j + c], out=unlike[:c])
                own += unlike[:c].view(np.uint8)
            np.minimum(other[o : o + c], other[o + 1 : o + 1 + c], out=step[:c])
            step[:c] += 1
            np.minimum(own, step[:c], out=own)
        if s in ends:
            at = np.flatnonzero(end == s)
            out[of[at]] = d[s % 2][(delta[at] + base) // 2, at] <= most[at]
        if s % STEP == 0:
            for v in d:
                np.minimum(v, cap * one, out=v)
            stay = (end > s) & ((d[0] <= bound[0]).any(0) | (d[1] <= bound[1]).any(0))
            left_over = np.count_nonzero(stay)
            if not left_over:
                break
            if left_over < 0.8 * len(of):
                of, end, delta, most = of[stay], end[stay], delta[stay], most[stay]
                x, y, one, *both = (v.compress(stay, 1) for v in (x, y, one, *d, *bound))  # indexing would leave columns together, not rows
                d, bound, step, unlike = both[:2], both[2:], step[:, :left_over].copy(), unlike[:, :left_over].copy()
    return out


def norms(text: str | None) -> list[bytes]:
    """The normalised lines of a text, the empty ones too."""
    data = _plain(text or "")
    if b"  " in data or any(c in data for c in (b"\t", b"\r", b"\x0b", b"\x0c")):
        return [b" ".join(x.split()) for x in data.split(b"\n")]
    return [x.strip(b" ") for x in data.split(b"\n")]


def _chars(norms: list[bytes]) -> np.ndarray:
    """The characters of lines that aren't empty."""
    sizes = np.fromiter(map(len, norms), np.int64, len(norms))
    whole = b"".join(norms)
    if not whole or whole.isascii():
        return sizes
    return np.add.reduceat((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64)


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, pos, h1, h2, size) of every line that isn't empty; size is its normalised length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                at, pos, found = [], [], []
                for r, t in enumerate(column(b, "text").to_pylist()):
                    own = norms(t)
                    n = len(found)
                    found += filter(None, own)
                    at += [r] * (len(found) - n)
                    pos += [k for k, x in enumerate(own) if x]
                h, rows = line_hashes(found), pa.array(at, pa.int32())
                cols = [column(b, "doc_id").take(rows), column(b, "doc_hash").take(rows), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(_chars(found).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_hash", "pos", "h1", "h2", "size"])
        trim()

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, doc_hash long, pos int, h1 long, h2 long, size int")


def line_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, norm, size): the normalised lines of wanted (line, first), taken from the documents where they occur first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                line, found = [], []
                for t, ls, ps in zip(*(column(b, c).to_pylist() for c in ("text", "lines", "places"))):
                    own = norms(t)
                    line += ls
                    found += [own[p].decode("utf-8", "surrogatepass") for p in ps]
                yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(found, pa.string())], names=["line", "norm"])
        trim()

    at = wanted.groupBy(F.nullif("first.d", F.lit(-(2**63))).alias("i"), F.col("first.doc_hash").alias("h")).agg(F.collect_list("line").alias("lines"), F.collect_list("first.pos").alias("places"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    met = docs.join(at, docs["doc_id"].eqNullSafe(at["i"]) & (docs["key"] == at["h"])).select("text", "lines", "places")
    return met.mapInArrow(run, "line long, norm string").dropDuplicates(["line"]).withColumn("size", F.char_length("norm"))


def key_masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bit masks of the pigeonhole keys: the fewest blocks that must agree so that a key has about as many values as lines."""
    for agree in range(1, 5):
        blocks = radius + agree
        if 64 * agree // blocks >= np.log2(max(n, 2)) - 2 or agree == 4:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(own, agree)]


#: For each bin the order in which the others are asked for a number if it is empty.
_ASKED = np.argsort(np.random.default_rng(5).random((BINS, BINS)), axis=1)


def _grams(norms: list[bytes], size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, line) of the grams of so many bytes from each place of each line; the last ones are filled up with zeros, or left out if only whole ones count."""
    pad, count = size - 1, len(norms)
    data = np.frombuffer((b"\0" * pad).join([*norms, b"\0" * 8]), np.uint8)
    sizes = np.fromiter(map(len, norms), np.int64, count)
    n = int(sizes.sum()) + pad * count
    h = np.ndarray((n,), "<u8", data.data, 0, (1,)) & np.uint64((1 << 8 * size) - 1)
    row = np.repeat(np.arange(count), sizes + pad)
    own = np.ones(n, bool)
    stop = np.cumsum(sizes + pad)
    for k in range(1, pad + 1 + whole * pad):
        own[stop - k] = False  # what begins between two lines belongs to none
    h = h[own] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h, row[own]


def fingerprints(norms: list[bytes], gram: int) -> np.ndarray:
    """A row of BINS numbers for each line; an empty bin takes the number of the first bin, in an order of its own, that isn't."""
    h, at = _grams(norms, gram, False)
    out = np.full(len(norms) * BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, at * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), h.astype(np.uint32))
    out = out.reshape(-1, BINS)
    full = out != 0xFFFFFFFF
    row, bin_ = np.nonzero(~full)
    for nth in range(BINS):
        if not len(row):
            break
        ask = _ASKED[bin_, nth]
        good = full[row, ask]
        out[row[good], bin_[good]] = out[row[good], ask[good]]
        row, bin_ = row[~good], bin_[~good]
    return out


def _mixed(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    key = (key ^ number) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ key >> np.uint64(29)


def _minima(norms: list[bytes], gram: int, bands: int, rows: int, nth: int) -> np.ndarray:
    """For each line the keys of so many blocks of minima of its whole grams, each under a hash of its own; sets of keys differ by their number."""
    h, at = _grams(norms, gram, True)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    odd = np.random.default_rng(nth).integers(1 << 63, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = np.zeros((len(norms), bands), np.uint64) + np.arange(bands, dtype=np.uint64) + np.uint64(nth + 1 << 32)
    some = max(1, (1 << 18) // (len(h) * rows))  # bands at once: many small steps would cost more than the hashes
    for band in range(0, bands, some):
        g = h[:, None] * odd[band : band + some].reshape(-1)
        g ^= g >> np.uint64(32)
        least = np.minimum.reduceat(g, first, axis=0).reshape(len(norms), -1, rows)
        for r in range(rows):
            key[:, band : band + some] = _mixed(key[:, band : band + some], least[:, :, r])
    return key


def _shorter(norms: list[bytes]) -> list[tuple[int, int]]:
    """(number of a line, key) of what is left of each line of TINY characters at most when no, one or, from TWO characters on, two characters go."""
    out = []
    for i, x in enumerate(norms):
        if len(x) <= 4 * TINY and len(t := x.decode("utf-8", "surrogatepass")) <= TINY:
            left = {t[:k] + t[k + 1 :] for k in range(len(t))}
            if len(t) >= TWO:
                left |= {t[:j] + t[j + 1 : k] + t[k + 1 :] for k in range(len(t)) for j in range(k)}
            out += [(i, xxhash.xxh64_intdigest(z.encode("utf-8", "surrogatepass"), 7)) for z in left | {t}]
    return out


def _keys(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, further) of some lines, as _blocks() has them."""
    size, found = np.fromiter(map(len, norms), np.int64, len(norms)), []

    def put(at: np.ndarray, key: np.ndarray, number: np.ndarray) -> None:
        bands = key.shape[1]
        number = number & np.uint32(0xFF)
        further = (np.roll(number, 5 * bands // 16, 1) | np.roll(number, 11 * bands // 16, 1) << np.uint32(8)).astype(np.uint16)
        found.append((np.repeat(at, bands), key.reshape(-1), further.reshape(-1)))

    for least, most, gram in FULL:
        if len(at := np.flatnonzero((size >= least) & (size <= most))):
            f = fingerprints([norms[i] for i in at.tolist()], gram)
            k = np.zeros((len(f), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) + np.uint64(gram << 48)
            for r in range(ROWS):
                k = _mixed(k, f.reshape(-1, BANDS, ROWS)[:, :, r])
            put(at, k, f[:, ::ROWS])
    for nth, (least, most, gram, bands, rows) in enumerate(SETS):
        if len(at := np.flatnonzero((size >= least) & (size <= most))):
            k = _minima([norms[i] for i in at.tolist()], gram, bands, rows, nth)
            put(at, k, (k >> np.uint64(13)).astype(np.uint32))
    if left := _shorter(norms):
        at, k = (np.array(x, d) for x, d in zip(zip(*left), (np.int64, np.uint64)))
        found.append((at, k, np.zeros(len(k), np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, further): for every line (its number) its 64-bit keys, and for each of them two bytes of other numbers; lines have MIN_CHARS bytes at least."""
    found, begin, size = [], 0, 0
    for i, x in enumerate(norms):
        size += len(x) + 64
        if size >= PART or i == len(norms) - 1:
            at, *rest = _keys(norms[begin : i + 1])
            found.append((at + begin, *rest))
            begin, size = i + 1, 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    return tuple(np.concatenate(x) for x in zip(*found))


def band_rows(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of a line, key) of all keys of normalised lines; different blocks have different keys."""
    at, key, _ = _blocks(norms)
    return at, key.view(np.int64)


def memberships(documents: DataFrame) -> DataFrame:
    """The lines (h1) that share blocks, as stars.MET has them.

    Keys travel in packed arrays, one row for each part of a slice's keys; there are four parts a shuffle partition.
    """
    parts = 4 * max(shuffle_parts(documents.sparkSession), 64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                own = [x for x in {x for t in column(b, "text").to_pylist() for x in norms(t)} if len(x) >= MIN_CHARS]
                if not own:
                    continue
                size = _chars(own)
                own = [x for x, n in zip(own, size.tolist()) if n >= MIN_CHARS]
                at, key, further = _blocks(own)
                part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                key, further, node = key.astype(np.uint32)[order], further[order], line_hashes(own)[:, 0][at[order]]
                out = [(k, *(c[x:y].tobytes() for c in (key, further, node))) for k, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if x < y]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[c] for r in out], pa.binary()) for c in range(1, 4))], names=["part", "key", "further", "node"])
        trim()

    def meet(table: pa.Table) -> pa.Table:
        key, further, node = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("key", np.uint32), ("further", np.uint16), ("node", np.int64)))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # slices repeat lines
        further = further[order[new]]
        return stars.met(table.column("part")[0].as_py(), key[new], node[new], [further & np.uint16(0xFF), further >> np.uint16(8)], SMALL)

    rows = documents.select("text").mapInArrow(deal, "part int, key binary, further binary, node binary")
    return rows.groupBy("part").applyInArrow(meet, stars.MET)


def _bigrams(texts: list[str]) -> np.ndarray:
    """For each text a row of zeros and ones: which of PLACES the hashes of its pairs of characters fall on, the n-th of like pairs by itself.

    An edit takes away or adds four pairs at most, so the rows of two texts differ in at most four places an edit.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    inner = row[:-1] == row[1:]
    both = np.sort((row[:-1].astype(np.uint64) << np.uint64(42) | c[:-1] << np.uint64(21) | c[1:])[inner])  # 22 bits for the text
    own, pair = (both >> np.uint64(42)).astype(np.int64), both & np.uint64((1 << 42) - 1)
    new = np.r_[True, both[1:] != both[:-1]][: len(both)]
    nth = np.arange(len(both)) - np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
    h = (pair + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(texts), PLACES), np.float32)
    out[own, (h >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)] = 1
    return out


def near(texts: list[str], x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a text of x and one of y (as numbers of texts) that may be similar by their lengths and pairs of characters; no similar pair is left out."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ones = _bigrams(texts)
    # less than 2 ** 24, so exact; the longer text of two sets what is left of their similarity
    many, edits, size_ = ones.sum(1), ((1 - least) * size + 1e-9).astype(np.int64).astype(np.float32), size.astype(np.float32)
    p, q = (np.sort(z) if least <= 0 else z[np.argsort(size[z], kind="stable")] for z in (x, y))
    ones_q, size_q, found = np.ascontiguousarray(ones[q].T), size[q], []
    for k in range(0, len(p), STRIP):
        r = p[k : k + STRIP]
        v = slice(0, len(q)) if least <= 0 else slice(*np.searchsorted(size_q, [least * size[r[0]] - 1, size[r[-1]] / least + 1]).tolist())
        w = q[v]
        most = np.maximum(edits[r][:, None], edits[w])
        may = many[r][:, None] + many[w] - 2 * (ones[r] @ ones_q[:, v]) <= 4 * most
        may &= np.abs(size_[r][:, None] - size_[w]) <= most
        i, j = np.nonzero(may)
        found.append((r[i], w[j]))
    i, j = (np.concatenate(z) for z in zip(*found)) if found else (p, p)
    if x is y:
        i, j = i[i < j], j[i < j]
    order = np.lexsort((j, i))
    return i[order], j[order]


def joined(node: np.ndarray, root: np.ndarray, texts: list[str], groups: list[list[int]], x: np.ndarray, y: np.ndarray, grp: int, least: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Links (a, b) that join all groups (root) which similar pairs of x and y join; pairs that meet in a lesser group than grp too are left to that one."""
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while (s := up.get(r, r)) != r:
            up[r] = up.get(s, s)
            r = s
        return r

    sets, a, b = [frozenset(g) for g in groups], [], []
    i, j = near(texts, x, y, least)
    apart = root[i] != root[j]
    left = [(p, q) for p, q in zip(i[apart].tolist(), j[apart].tolist()) if min(sets[p] & sets[q]) == grp]
    at, many = 0, 512
    while at < len(left):  # what earlier pairs have joined isn't compared
        some = [(p, q) for p, q in left[at : at + many] if find(int(root[p])) != find(int(root[q]))]
        at, many = at + many, min(4 * many, 8192)
        for (p, q), good in zip(some, similar([texts[p] for p, _ in some], [texts[q] for _, q in some], least, alike=False).tolist()):
            if good and (r := find(int(root[p]))) != (s := find(int(root[q]))):
                up[max(r, s)] = min(r, s)
                a.append(int(node[p]))
                b.append(int(node[q]))
    return a, b


def roots(documents: DataFrame, distinct: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root): the connected groups of similar lines among numbered distinct lines (column line)."""
    met = staged(memberships(documents))
    texts = staged(line_texts(documents, distinct.join(met.select(F.col("node").alias("line")).distinct(), "line").select("line", "first")))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["a", "b"]][similar(b["x"].tolist(), b["y"].tolist(), least)]
        trim()

    def verify(pairs: DataFrame) -> DataFrame:
        size = texts.select("line", "size")
        pairs = pairs.join(size.toDF("a", "s"), "a").join(size.toDF("b", "t"), "b").filter(F.least("s", "t") >= F.lit(least) * F.greatest("s", "t") - 1e-9)
        return pairs.select("a", "b").join(texts.select(F.col("line").alias("b"), F.col("norm").alias("y")), "b").join(texts.select(F.col("line").alias("a"), F.col("norm").alias("x")), "a").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        grp, i, j = (k.as_py() for k in key)
        node, root, b = (table.column(c).to_numpy() for c in ("node", "root", "b"))
        x = np.flatnonzero(b == i)
        y = x if i == j else np.flatnonzero(b == j)
        found = joined(node, root, table.column("norm").to_pylist(), table.column("groups").to_pylist(), x, y, grp, least)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    def rest(rows: DataFrame) -> DataFrame:
        rows = staged(rows)
        groups = rows.groupBy("node").agg(F.collect_set("grp").alias("groups"))
        own = groups.join(texts.select(F.col("line").alias("node"), "norm"), "node")
        return rows.join(own, "node").groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")

    return stars.roots(met, verify, rest)


def classes(documents: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(occurrences, table): all lines that aren't empty, and for each distinct one its class, the class's size and its first occurrence."""
    occurrences = staged(lines(documents))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "doc_hash", "pos")).alias("first")
    distinct = occurrences.groupBy("h1", "h2").agg(F.first("size").alias("size"), first, F.count(F.lit(1)).alias("n"))
    # two lines of one 64-bit id are 2 ** -64 likely a pair; the texts compared afterwards belong to both halves
    distinct = staged(distinct.withColumn("line", F.col("h1")))
    own = roots(documents, distinct, least)
    linked = staged(distinct.join(own, distinct.line == own.node).select("line", "root", "first", "n"))
    best = linked.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    of = linked.select("line", "root").join(best, "root").select(F.col("line").alias("_l"), "root", F.col("first").alias("f"), F.col("n").alias("m"))
    table = distinct.join(of, distinct.line == of._l, "left").select("h1", "h2", F.coalesce("root", "line").alias("class_id"), F.coalesce("f", "first").alias("first"), F.coalesce("m", "n").alias("n"))
    return occurrences, table


def dropped(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, doc_hash, drop): the line numbers that each document loses."""
    occurrences, table = classes(documents, least)
    again = occurrences.join(table.filter("n > 1"), ["h1", "h2"]).withColumn("d", F.coalesce("doc_id", F.lit(-(2**63))))
    again = again.filter(~((F.col("first.d") == F.col("d")) & (F.col("first.doc_hash") == F.col("doc_hash")) & (F.col("first.pos") == F.col("pos"))))
    return again.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def deduplicated(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """documents without the lines that a class already has; n_chars, if there, follows the text."""
    i, h, drop, key = (fresh(x, documents) for x in ("first_id", "first_hash", "drop", "key"))
    gone = dropped(documents, least).toDF(i, h, drop)
    docs = documents.withColumn(key, F.xxhash64("text"))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[i]) & (docs[key] == gone[h]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, n: ~F.array_contains(drop, n)), "\n")
    out = joined.withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns)


def query(documents: DataFrame) -> DataFrame:
    """One row per document: its lines dropped and kept, and a digest of what is left."""
    left = deduplicated(documents.select("doc_id", "text")).withColumnRenamed("text", "kept")
    return left.select("doc_id", F.xxhash64("kept").alias("kept_digest"), F.char_length("kept").alias("kept_chars"), F.size(F.split("kept", "\n", -1)).alias("kept_lines"))
