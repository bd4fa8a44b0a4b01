"""Joins by an equality and further comparisons, whose keys are dealt to blocks."""

import pytest

from tempora.dialect.parser import parse
from tempora.plans import lower as lowering

TEXT = "SELECT {} FROM a JOIN b ON {} AND a.x > b.y;"


@pytest.fixture
def tables(spark):
    a = spark.createDataFrame([(i, None if i % 50 == 7 else i % 3 if i % 10 else 9, i * 37 % 101) for i in range(400)] + [(1, 0, 50)] * 3, "i int, k int, x int")
    b = spark.createDataFrame([(i, i % 4 if i % 9 else None, i * 29 % 103, "z") for i in range(150)] + [(2, 0, 20, "z")] * 3, "j long, g long, y int, x0 string")
    return {"a": a, "b": b}


@pytest.mark.parametrize("on", ["a.k = b.g", "b.g = a.k"])
@pytest.mark.parametrize("items", ["i, j", "*"])
def test_blocks_give_the_rows_of_the_plain_join(tables, monkeypatch, on, items):
    want = tables["a"].join(tables["b"], (tables["a"].k == tables["b"].g) & (tables["a"].x > tables["b"].y))
    want = want if items == "*" else want.select("i", "j")
    monkeypatch.setattr(lowering, "BLOCK", 16, raising=False)
    got = lowering.lower(parse(TEXT.format(items, on)), tables.__getitem__)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_task_has_all_pairs_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(lowering, "BLOCK", 64, raising=False)
    most = []
    for n in (1000, 2000):
        tables = {"a": spark.range(n).selectExpr("id DIV 100000 AS k", "id AS x"), "b": spark.range(n).selectExpr("id DIV 100000 AS g", "id AS y")}
        got = lowering.lower(parse(TEXT.format("x, y", "a.k = b.g")), tables.__getitem__)
        sizes = [r[1] for r in got.groupBy(lowering.F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n * (n - 1) // 2
        most.append(max(sizes))
    assert max(most) < 40 * 64 * 64  # 500,000 and 2,000,000 in one task before
