"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from causeway.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return v if v is None or isinstance(v, int | bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    rows, sql = df.collect(), registry.oracle_sql().get(name)
    assert len(set(df.columns)) == len(df.columns)
    assert rows, "a query without rows shows nothing"
    if sql is None:
        return
    want = duck.execute(sql).fetchall()
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in want), key=repr)


def test_each_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
