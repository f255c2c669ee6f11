"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from partita.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(same(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_registers_every_query():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(catalogue.queries()) <= set(q) and set(o) <= set(q) and len(q) >= 150
