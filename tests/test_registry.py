import duckdb
import pytest

from tempora.plans import registry
from tempora.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df, cur = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name])
    cols = sorted(df.columns)
    theirs = [x[0] for x in cur.description]
    assert cols == sorted(theirs)
    want = sorted(repr(tuple(r[theirs.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
