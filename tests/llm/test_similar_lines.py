"""Line dedup against edit similarities of all pairs."""

import time

import numpy as np

from tempora.llm import linededup, stars


def _words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9))) for _ in range(n)]


def _edited(rng):
    """Lines of 6 to 60 words and, of each, a copy with one word in ten changed."""
    for n in (6, 8, 10, 15, 20, 30, 60) * 12:
        line = _words(rng, n)
        bent = list(line)
        for k in rng.choice(n, max(1, n // 10), replace=False):
            bent[k] = _words(rng, 1)[0]
        yield " ".join(line), " ".join(bent)


def test_lines_with_changed_words_are_candidates():
    pairs = [p for p in _edited(np.random.default_rng(6)) if linededup.similarity(*p)]
    at, key = linededup.band_rows([x.encode() for p in pairs for x in p])
    keys = [set(key[at == i].tolist()) for i in range(2 * len(pairs))]
    met = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs)))
    assert len(pairs) > 70 and met >= 0.97 * len(pairs)


def test_lines_with_changed_words_go(spark):
    rng = np.random.default_rng(7)
    hot = " ".join(_words(rng, 30))  # a key of more lines than are compared in all pairs, not all similar to the least
    rows = [x for p in _edited(rng) for x in p] + [hot[:k] + "".join(rng.choice(list("xyz"), 16)) + hot[k + 16 :] for k in rng.integers(0, len(hot) - 16, 120)]
    rows = [x for x in dict.fromkeys(rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and linededup.similarity(rows[i], rows[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in linededup.deduplicated(docs).collect() if r.text}
    assert set(root) <= left and len(left - set(root)) <= 2


def test_unlike_lines_with_one_end_share_hardly_any_key():
    rng = np.random.default_rng(14)
    most = []
    for n in (1000, 4000):
        at, key = linededup.band_rows([(" ".join(_words(rng, int(rng.integers(2, 12)))) + " end.").encode() for _ in range(n)])
        most.append(np.unique(key, return_counts=True)[1].max())
    assert max(most) <= linededup.SMALL


def test_all_similar_lines_of_few_characters_are_candidates():
    rng = np.random.default_rng(15)
    rows = []
    for n in [*range(5, 15)] * 20:
        a = list(rng.choice(list("abcdeé語 "), n))
        b = list(a)
        for _ in range(int(0.2 * n)):
            k = int(rng.integers(0, len(b)))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcxyz"), int(rng.integers(0, 2))))
        rows += ["".join(a), "".join(b)]
    at, key = linededup.band_rows([x.encode() for x in rows])
    keys = [set(key[at == i].tolist()) for i in range(len(rows))]
    pairs = [(i, i + 1) for i in range(0, len(rows), 2) if rows[i] != rows[i + 1] and 5 <= min(map(len, rows[i : i + 2])) and max(map(len, rows[i : i + 2])) <= 14 and linededup.similarity(*rows[i : i + 2])]
    assert len(pairs) > 100 and all(keys[i] & keys[j] for i, j in pairs)


def test_every_pair_of_a_large_key_is_compared(spark):
    n = 700  # more rows than a block has
    for few in (16, n // 2):
        met = spark.createDataFrame(stars.met(3, np.zeros(n, np.uint64), np.arange(n), [np.arange(n) % 5], few).to_pandas(), stars.MET)
        got = {r.node: r.root for r in stars.roots(met, lambda pairs: pairs.filter("a % 7 = 3 AND b = a + 1 OR a % 7 = 0 AND b % 7 = 0")).collect()}
        want = {k: 0 for k in range(0, n, 7)} | {k + d: k for k in range(3, n, 7) for d in (0, 1)}
        assert got == want


def test_no_similar_pair_is_lost_before_its_edits_are_counted():
    rng = np.random.default_rng(9)
    rows = [x for p in _edited(rng) for x in p] + ["aaaaa", "aaaab", "日本語の行です", "日本語の行でも", "ab" * 300, "ab" * 280, "ba" * 300]
    every = np.arange(len(rows))
    got = set(zip(*(c.tolist() for c in linededup.near(rows, every, every, 0.8))))
    pairs = {(i, j) for j in range(len(rows)) for i in range(j) if linededup.similarity(rows[i], rows[j])}
    assert len(pairs) > 70 and pairs <= got and len(got) < 5 * len(pairs)
    odd, even = every[1::2], every[::2]
    assert {(i, j) for i, j in pairs if i % 2 == 0 and j % 2} <= set(zip(*(c.tolist() for c in linededup.near(rows, even, odd, 0.8))))


def _distance(a, b):
    row = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([c != d for d in b], int))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_edits_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(11)
    pairs = [("a" * 30, "a" * 24), ("", "abc"), ("abc", ""), ("", ""), ("abcde", "abcde"), ("ab" * 40, "ba" * 40), ("日本語の行です。" * 5, "日本語の列です。" * 5)]
    for letters in ("ab", "abcdefghij ", "äöü€語xyz", "".join(map(chr, range(0x4E00, 0x4E00 + 700)))):
        for n in [*range(5, 60, 3)] * 3 + [150, 300] * 5:
            a = list(rng.choice(list(letters), n))
            b = list(a)
            for _ in range(int(rng.integers(0, n // 2 + 2))):
                k = int(rng.integers(0, len(b) + 1))
                b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list(letters), int(rng.integers(0, 3))))
            pairs += [("".join(a), "".join(b)), ("".join(b), "".join(a))]
    long = ["".join(rng.choice(list("abcdefg "), 1400)) for _ in range(30)]
    pairs += [(x, x[k:] + x[:k]) for k, x in zip(range(0, 300, 10), long)]  # more edits than a byte holds
    for least in (0.8, 0.6, 0.95):
        want = [_distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
        for alike in (True, False):
            assert linededup.similar([a for a, _ in pairs], [b for _, b in pairs], least, alike).tolist() == want
        assert [linededup.similarity(a, b, least) for a, b in pairs] == want and 50 < sum(want) < len(want)


def test_edits_of_many_pairs_cost_less_than_one_by_one():
    rng = np.random.default_rng(12)
    shared = " ".join(_words(rng, 70))
    rows = [" ".join(_words(rng, 25)) + " " + shared + " " + " ".join(_words(rng, 25)) for _ in range(40)]
    a, b = zip(*((x, y) for x in rows for y in rows if x < y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y))))
    began = time.process_time()
    got = linededup.similar(list(a), list(b), alike=False)
    between = time.process_time()
    assert got.tolist() == [linededup.similarity(x, y) for x, y in zip(a, b)] and len(a) > 500
    assert 2 * (between - began) < time.process_time() - between


def test_similar_lines_of_a_large_key_go(spark):
    rng = np.random.default_rng(10)
    shared = " ".join(_words(rng, 25))  # more than half of a line, yet too little for the lines to be similar
    base = [shared + " " + " ".join(_words(rng, 18)) for _ in range(350)]
    rows = [r for x in base for r in (x, x[:-12] + "".join(rng.choice(list("xyz"), 12)))]
    at, key = linededup.band_rows([x.encode() for x in rows])
    keys, root = [set(key[at == i].tolist()) for i in range(len(rows))], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and keys[i] & keys[j] and linededup.similarity(rows[i], rows[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in linededup.deduplicated(docs).collect() if r.text}
    assert max(np.unique(key, return_counts=True)[1]) > linededup.SMALL and 300 < len(set(root)) < 400
    assert left == set(root)


def test_equal_lines_of_every_length_go(spark):
    own = ["alpha one", "beta two", "gamma three", "delta four"]
    texts = [f"{own[i]}\nyes\n\n日本語の行はここに空白なしで続きます\nx  y\nok\n\nX y" for i in range(4)]
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "alpha one\nyes\n\n日本語の行はここに空白なしで続きます\nx  y\nok\n"
    assert all(got[i] == f"{own[i]}\n\n" for i in (1, 2, 3))
