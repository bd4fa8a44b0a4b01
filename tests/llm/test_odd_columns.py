"""Null ids beside ids that no double holds, columns with the operators' own names, and the pipeline over odd rows."""

import pytest

import corpus_pipeline
from tempora.llm import decontam, katz, linededup, minhash, quality, secrets, sentencepieces, simhash, stars, toxicity

BIG = 2**53 + 1
NAMES = ("drop", "_k", "_n", "_id", "_h", "_items", "_toxic", "key", "many", "first_id", "first_hash", "row_key", "toxic_score", "items")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, "one line of the first text\nand another of it", 26), (None, "one line of the first text", None), (5, None, None), (BIG + 2, "password = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 50)]
    rows = [(*r, *(f"{c}{i}" for c in NAMES), "en", "s") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES) + ", lang string, source string").repartition(1)


def _same(docs, out, but=("text", "n_chars")):
    """Every row of out has the columns of docs, untouched."""
    had = {r.drop: r.asDict() for r in docs.collect()}
    rows = out.collect()
    assert set(docs.columns) - {"text"} <= set(out.columns)
    for r in rows:
        want, got = had[r.drop], r.asDict()
        assert all(got[c] == want[c] for c in docs.columns if c not in but)
    return rows


def test_ids_stay_whole_beside_nulls(spark, docs):
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "another")], "item_id long, text string")
    want = {BIG, None, 5, BIG + 2}
    for f in (linededup.query, simhash.query, sentencepieces.query, katz.query, lambda d: decontam.query(d, items), lambda d: quality.query(d, labels), lambda d: toxicity.query(d, labels)):
        assert {r.doc_id for r in f(docs).collect()} == want
    assert {r.doc_id for r in secrets.query(docs).collect()} == {BIG + 2}


def test_own_column_names_pass_through(spark, docs):
    items = spark.createDataFrame([(1, "another of it all")], "item_id long, text string")
    lines = _same(docs, linededup.deduplicated(docs))
    # a null id comes first, so its line is the one that stays
    assert {r.doc_id: r.text for r in lines}[BIG] == "and another of it" and {r.doc_id: r.n_chars for r in lines}[BIG] == 17
    assert len(_same(docs, simhash.representatives(docs), ())) == 4
    assert len(_same(docs, minhash.representatives(docs), ())) == 4
    assert len(_same(docs, decontam.clean(docs, items), ())) == 4
    assert len(_same(docs, sentencepieces.encoded(docs), ())) == 4


def test_samples_dont_depend_on_a_null_beside(spark, docs):
    alone = sentencepieces.encoded(docs.filter(f"doc_id = {BIG}")).first().samples
    assert {r.doc_id: r.samples for r in sentencepieces.encoded(docs).collect()}[BIG] == alone


def test_pipeline_over_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(BIG, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {BIG, None, 5} and all(r.round_trip for r in out.values())  # the last text holds the benchmark item
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_met_in_splits_large_groups():
    import numpy as np

    rng = np.random.default_rng(1)
    key, node, more = rng.integers(0, 3, 200).astype(np.uint64), np.arange(200), rng.integers(0, 4, 200).astype(np.uint16)
    group, row, lead, few = stars.met_in(key, node, [more], 16)
    assert {(int(a), int(b)) for a, b in zip(key[row], key[lead])} == {(k, k) for k in range(3)}
    assert set(row.tolist()) == set(range(200))  # nobody is left out
    for g in set(group[few].tolist()):
        assert 1 < (group == g).sum() <= 16 and len(set(zip(key[row[group == g]].tolist(), more[row[group == g]].tolist()))) <= len(set(more.tolist()))
    assert all(node[lead[group == g]].max() == node[row[group == g]].min() for g in set(group.tolist()))


def test_long_texts_have_the_same_statistics_in_any_block(monkeypatch):
    from tempora.llm import common

    text = " ".join(f"w{k % 97}x{k % 13}" for k in range(5000))
    whole = quality.features(text)
    blocks = list(common.word_blocks(text, 1000))
    assert sum(blocks, []) == text.encode().split() and len(blocks) > 10
    monkeypatch.setattr(quality, "word_blocks", lambda t: common.word_blocks(t, 1000))
    assert quality.features(text) == whole
    monkeypatch.setattr(simhash, "word_blocks", lambda t: common.word_blocks(t, 1000))
    had = simhash.fingerprint(text)
    monkeypatch.undo()
    assert simhash.fingerprint(text) == had


def test_pu_gradient_against_numeric_differences():
    """Far from its optimum the fit only lowers the risk, and the risk it ends at beats any small step."""
    import numpy as np

    rng = np.random.default_rng(2)
    p, u = (rng.random((60, 5)) < 0.6).astype(np.float32), np.vstack([(rng.random((50, 5)) < 0.6), (rng.random((70, 5)) < 0.2)]).astype(np.float32)
    prior, ridge = 0.4, 2e-4

    def risk(w, b):
        zp, zu = p @ w + b, u @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()) + ridge / 2 * (w @ w)

    w, b = quality._minimise(p, u, prior, 3000, 0.01)
    best = risk(w, b)
    assert best < risk(np.zeros(5), 0.0)
    for k in range(5):
        for step in (-0.1, 0.1):
            moved = w.copy()
            moved[k] += step
            assert risk(moved, b) >= best - 1e-4
    assert min(risk(w, b - 0.1), risk(w, b + 0.1)) >= best - 1e-4


def test_benchmark_places_against_the_edit_table():
    import numpy as np

    rng = np.random.default_rng(5)
    letters = list("abcdef ")
    for _ in range(60):
        items = [(k, decontam.normalised("".join(rng.choice(letters, rng.integers(12, 60))))) for k in range(3)]
        text = decontam.normalised("".join(rng.choice(letters, 40)) + " " + items[0][1])
        for k in rng.integers(0, len(text), rng.integers(0, 5)):
            text = text[:k] + rng.choice(letters) + text[k + 1 :]
        text = decontam.normalised(text)
        want = []
        for i, item in items:
            row = [0] * (len(text) + 1)
            for n, a in enumerate(item, 1):
                new = [n]
                for j, c in enumerate(text, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
                row = new
            if item and min(row) <= decontam.budget(item):
                want.append((i, min(row)))
        assert decontam.Matcher(items).find(text) == want
