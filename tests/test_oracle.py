"""Every query with SQL gives the same rows as the SQL does."""

import datetime

import duckdb
import pytest

from barloom.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events clicks".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(queries()) - set(oracle_sql())):
        df = queries()[name](spark, sf)
        assert df.columns and df.limit(5).collect() is not None
