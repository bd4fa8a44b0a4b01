"""Brute-force versions of the operators, and the cases that every one of them has to bear."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tempora.llm import decontam, katz, licenses, linededup, quality, secrets, sentencepieces, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, words string"
ODD = [None, "", " ", "a", "a b", "the cat sat on the mat\nthe cat sat on the mat now", "é ☃\n\n", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    texts = [*ODD, ODD[5], *(" ".join(f"w{k}" for k in rng.integers(0, 60, 40)) for _ in range(30))]
    texts += [texts[-1], texts[-1] + " tail", "Released under the MIT License.\ntoken = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" here"]
    rows = [(None if i == 4 else 7 if i in (8, 9) else i, t, "en", "s", len(t or ""), "c", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(filter(lambda x: x is not None, (least.get(c), r.doc_id)), default=None)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least[c])) for r, f, c in zip(rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.query(docs).collect()) == want
    left = simhash.representatives(docs)
    assert left.columns == docs.columns and left.count() == len(set(comp))


def test_vantage_point_links_are_all_found():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    pts = np.unique(np.concatenate([base, near]))
    i, j = simhash.linked(pts, 2, 64)
    a, b = np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 2)
    from tempora.llm.common import local_roots

    assert (local_roots(len(pts), i, j) == local_roots(len(pts), a, b)).all()
    tree = simhash.Tree(pts, 100, 2)
    leaf, idx = tree.route(pts)
    seen = collections.defaultdict(set)
    for x, y in zip(leaf, idx):
        seen[int(y)].add(int(x))
    assert all(seen[int(x)] & seen[int(y)] for x, y in zip(a, b))


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(230)] + [(i, [0.25] * 6) for i in range(300, 330)]
    rows += [(400, None), (500, [1.0, float("nan")]), (600, [float("inf")] * 6), (None, [0.5] * 6), (700, []), (3, [0.25] * 6), (800, [9.0, 8.0]), (801, [1.0, 1.0])]
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(map(math.isfinite, v))]
    want = []
    for i, v in q:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:10]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    got = topk.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_katz_against_dictionaries(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    toks = [(r.doc_id, (r.text or "").encode().lower().split() + [b" "]) for r in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in toks]
    uni, bi = collections.Counter(), collections.Counter()
    for (_, t), h in zip(toks, held):
        if not h:
            uni.update(t)
            bi.update(zip([b" ", *t], t))
    n = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    model, d = katz.Unigrams(np.array([sum(uni.values()), len(uni), *n(uni)])), katz.discounts(n(bi))
    low = lambda w: float(model.p(np.array([uni[w]]))[0])
    assert abs(sum(map(low, uni)) + model.unknown - 1) < 1e-9
    by = collections.defaultdict(dict)
    for (h, w), r in bi.items():
        by[h][w] = r
    def p(h, w):
        if not uni[h]:
            return low(w)
        kept = sum((d[r] if r <= 5 else 1) * r for r in by[h].values())
        free = max(1 - kept / uni[h], 1 / (uni[h] + 1))
        if (r := by[h].get(w, 0)):
            return (d[r] if r <= 5 else 1) * r * (1 - free) / kept
        return free / (1 - sum(map(low, by[h]))) * low(w)
    h = max(by, key=lambda x: len(by[x]))
    assert abs(sum(p(h, w) for w in [*uni, b"?"]) - 1) < 1e-9
    want = sorted((str(i), len(t), sum(uni[w] > 0 for w in t), round(sum(math.log10(p(a, w)) for a, w in zip([b" ", *t], t)), 6), round(sum(math.log10((uni[w] + 1) / (sum(uni.values()) + len(uni) + 1)) for w in t), 6)) for i, t in toks)
    for size in (10**6, 200):
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in katz.scores(docs, block_tokens=size).collect())
        assert got == want


def test_decontamination():
    rng = np.random.default_rng(2)
    item = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(20))
    m = decontam.Matcher([(1, item), (2, None), (3, "")])
    bent = list(item)
    for k in range(0, len(bent), 12):
        bent[k] = "z"
    for text, want in (("x " + item.upper() + " y", 0), ("q" * 50 + "".join(bent), len(item) // 12 + 1), ("nothing of it", None), (None, None), ("", None)):
        found = m.find(text)
        assert (found == [(1, want)] or want and found and found[0][1] <= want) if want is not None else not found
    def edits(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(2))
        assert decontam.myers(decontam.masks(p), len(p), t, len(p)) == edits(p, t)


def test_line_dedup(spark):
    line = "this is the very line that many documents of this crawl repeat again and again"
    bits = lambda x: int(linededup.simhashes([linededup.normalised(x).encode().split()]).view(np.uint64)[0])
    near = next(v for v in (f"{line} {w}" for w in ("ok", "so", "yes", "now", "still", "too", "here", "there", "well", "much", "more", "x", "y", "z", "q")) if 0 < (bits(v) ^ bits(line)).bit_count() <= 3)
    rows = [(i, f"{near if i % 2 else line}\nown text number {chr(97 + i)} of the document {chr(97 + i) * 9}") for i in range(6)] + [(None, line), (9, None), (10, "short"), (2, f"{line} \nown text number c of the document ccccccccc")]
    got = {(r.doc_id, r.text) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(line in (t or "") for _, t in got) == 1 and (9, None) in got and (10, "short") in got
    assert sum("own text" in (t or "") for _, t in got) == 6
    assert linededup.similarity("abcdefghij", "abcdefghiX") and not linededup.similarity("abcdefghij", "abcdeXXXij")


def test_every_pair_meets_in_a_key():
    rng = np.random.default_rng(4)
    for n in (10, 10**6, 10**9):
        masks = linededup.key_masks(n)
        for _ in range(200):
            flips = rng.choice(64, linededup.RADIUS, replace=False)
            assert any(not any(m >> int(b) & 1 for b in flips) for m in masks)


def test_encoding_and_samples():
    c = sentencepieces.codec(sentencepieces.MODEL)
    for t in [x for x in ODD if x] + ["  two  spaces \n line", "日本 🎉 z\n", "\t tab"]:
        assert c.encode(t) == c.sp.encode(t) and c.decode(c.encode(t)) == t
    for s in sentencepieces.sample(c, ["the in", "hello world\nagain"], [1, 2], 3):
        assert len({tuple(i) for i, _, _ in s}) == 3
    assert sentencepieces.sample(c, [None, ""], [1, 2], 3) == [[([], 0.0, 0.0)]] * 2
    one = sentencepieces.sample(c, ["the in"], [9], 3)
    both = sentencepieces.sample(c, ["other text", "the in"], [4, 9], 3)[1]
    assert [(list(i), a, b) for i, a, b in one[0]] == [(list(i), a, b) for i, a, b in both]


def test_secrets_and_licenses(docs):
    found = secrets.query(docs).filter("is_secret").collect()
    assert any(r.length == 40 for r in found)
    got = {r.doc_id: r for r in licenses.query(docs).collect()}
    assert any(r.license_id == "MIT" and r.origin == "header" for r in got.values())


def test_classifiers_bear_odd_rows(docs, labels):
    for m in (quality, toxicity):
        rows = m.query(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert m.query(docs.limit(0), labels.limit(0)).count() == 0


def test_empty_and_clashing_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8"), (None, "x"), (2, None)], "item_id long, text string")
    assert decontam.clean(docs, items).columns == docs.columns
    assert sentencepieces.encoded(docs).count() == docs.count()
    for f in (linededup.query, licenses.query, secrets.query, simhash.query, sentencepieces.query, katz.query, lambda d: decontam.query(d, items)):
        assert f(none).count() == 0


def test_samples_against_all_segmentations():
    c = sentencepieces.codec(sentencepieces.MODEL)
    lat, text, n = c.lattice, "then or", 4000
    words, _ = lat.words([text])
    every = collections.Counter()

    def go(chunk, node, ids, logp):
        for e in range(lat.first.a[node], lat.first.a[node + 1]):
            now, lp = [*ids, *lat.expand(np.array([e])).tolist()], logp + lat.logp.a[e]
            if not lat.last.a[e]:
                go(chunk, node + int(lat.size.a[e]), now, lp)
            elif chunk + 1 < len(words):
                go(chunk + 1, lat.start.a[words[chunk + 1]], now, lp)
            else:
                every[tuple(now)] += math.exp(lp)

    go(0, lat.start.a[words[0]], [], 0.0)
    assert abs(sum(every.values()) - 1) < 1e-9
    drawn = sentencepieces.sample(c, [text] * n, [xxhash.xxh64_intdigest(str(i)) for i in range(n)], 3)
    ids = [[tuple(x.tolist()) for x, _, _ in d] for d in drawn]
    assert all(len(set(i)) == 3 and set(i) <= set(every) for i in ids)
    for s, p in every.most_common(8):
        second = sum(q * p / (1 - q) for o, q in every.items() if o != s)
        assert abs(sum(i[0] == s for i in ids) / n - p) < 0.03 and abs(sum(i[1] == s for i in ids) / n - second) < 0.03
    assert abs(np.mean([sum(math.exp(lp - li) for _, lp, li in d) for d in drawn]) - 1) < 0.02


def test_long_texts_and_a_lattice_begun_anew(monkeypatch):
    c = sentencepieces.codec(sentencepieces.MODEL)
    texts = ["y" * 3000, "the and of " * 900, "☃" * 700, "日 x"]
    want = sentencepieces.sample(c, texts, [1, 2, 3, 4], 3)
    monkeypatch.setattr(sentencepieces, "NODES", 0)
    for t, k, w in zip(texts, (1, 2, 3, 4), want):
        got = sentencepieces.sample(c, [t], [k], 3)[0]
        assert [(list(i), a, b) for i, a, b in got] == [(list(i), a, b) for i, a, b in w]
        assert len({tuple(i) for i, _, _ in got}) == len(got)  # texts with fewer segmentations have fewer samples


def test_a_worker_keeps_no_lattice_after_its_task(spark):
    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sentencepieces.codec(sentencepieces.MODEL).lattice.points.n] * b.num_rows, pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, f"words of text {i} and more") for i in range(40)], "doc_id long, text string").repartition(4)
    many, few = (sorted((r.doc_id, r.ids, r.samples) for r in sentencepieces.encoded(docs, **own).collect()) for own in ({}, {"nodes": 20, "size": 60}))
    assert many == few and len(many) == 40
    assert {r.n for r in docs.mapInArrow(kept, "n long").collect()} == {0}
