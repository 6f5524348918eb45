"""Every query with a SQL equivalent against it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = sorted(set(entry.registry.queries()) & set(entry.registry.oracle_sql()))


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 6))
    return repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols, sql_rows = [c[0] for c in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in sql_rows)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
