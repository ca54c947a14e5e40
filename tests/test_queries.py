"""The queries of plans.checks against their SQL."""

import inspect

import duckdb
import pytest

from gaugeworks.plans import catalogue, checks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in inspect.getmembers(checks, inspect.isfunction) if f.__module__ == checks.__name__ and n in catalogue.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_there_are_queries():
    assert len(NAMES) > 30


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)
