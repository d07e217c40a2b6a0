"""Every registered table query against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(spark, duck, name, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(shown(dict(zip(names, row))[c]) for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    same(spark, duck, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"extract_web_pages"}  # test_sources.py has a plain form
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
