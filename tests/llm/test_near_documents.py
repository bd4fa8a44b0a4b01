"""The near-duplicate stage against all pairs."""

import numpy as np

import corpus_pipeline
from tempora.llm import minhash, neardocs, simhash


def _bent(rng, words, changes):
    out = list(words)
    for k in rng.choice(len(out), changes, replace=False):
        out[k] = f"new{rng.integers(10**6)}"
    return out


def _groups(texts):
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_stage_drops_near_copies_of_jaccard_08(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "a b", "A  b"]
    for _ in range(40):
        base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
        texts += [" ".join(base), " ".join(_bent(rng, base, 2)), " ".join(_bent(rng, base, 3)), " ".join(_bent(rng, base, 12))]
    hot = [f"h{k}" for k in range(100)]  # a key of more than SMALL texts, not all of them similar to the least
    texts += [" ".join(_bent(rng, hot, int(c))) for c in rng.integers(1, 4, 150)]
    root = _groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left == sorted(set(root))
    assert len(texts) - len(left) > 100


def test_stage_links_by_simhash_and_vantage_point_trees(spark, monkeypatch):
    made, tree = [], simhash.Tree
    monkeypatch.setattr(simhash, "Tree", lambda *a: made.append(a) or tree(*a))
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j {i // 2}") for i in range(8)], "doc_id long, text string")
    left = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left == [0, 2, 4, 6] and len(made) == neardocs.TABLES


def test_similar_texts_are_near_in_a_part_of_their_fingerprints():
    rng, fps = np.random.default_rng(11), []
    for n in rng.integers(9, 300, 1500):
        h, same = rng.integers(0, 1 << 63, 2 * n, np.uint64), -(-8 * n // 9)  # similarity 0.8, or little more
        fps += [neardocs.fingerprint(h[:n]), neardocs.fingerprint(np.r_[h[:same], h[n : 2 * n - same]])]
    whole = neardocs.wholes(fps)
    met = np.zeros(1500, bool)
    for t in range(neardocs.TABLES):
        rows, group = neardocs.candidates(neardocs.part(whole, t), np.ascontiguousarray(whole[:, : neardocs.CHECKED]))
        of = np.arange(-3000, 0)
        of[rows] = group
        met |= of[::2] == of[1::2]
        assert len(set(of.tolist())) > 1500 - 20  # few unrelated ones are linked
    assert met.sum() >= 0.997 * len(met)


def test_a_tree_of_many_shards_loses_no_near_part():
    rng = np.random.default_rng(12)
    values = rng.integers(0, 1 << neardocs.BITS, 4000, np.uint32)
    values[1::2] = values[::2] ^ (np.uint32(1) << rng.integers(0, neardocs.BITS, 2000).astype(np.uint32))
    tree = simhash.Tree(values[:1000].astype(np.uint64), 50, neardocs.NEAR)
    shard, idx = tree.route(values)
    shards = [set(shard[idx == i].tolist()) for i in range(4000)]
    assert tree.leaves > 10 and all(shards[i] & shards[i + 1] for i in range(0, 4000, 2))
