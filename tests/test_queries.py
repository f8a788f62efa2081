"""Every query of the library beside its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from corpusloom import plans

SF = "/root/testdata/sf0.001"
#: Where the smallest tables have nothing for a query.
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return {sf: views(sf) for sf in (SF, LARGER)}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    sql = plans.oracle_sql().get(name)
    for sf in (SF, LARGER):
        got = plans.queries()[name](spark, sf)
        rows = [tuple(r) for r in got.collect()]
        if sql is None:  # held against plain loops in test_retrieval.py
            assert rows and len(got.columns) == len(set(got.columns))
            return
        found = duck[sf].execute(sql)
        columns, want = [d[0] for d in found.description], found.fetchall()
        assert sorted(got.columns) == sorted(columns)
        assert table(got.columns, rows) == table(columns, want)
        if want:
            return
    raise AssertionError("the SQL finds nothing on either tables")


def test_every_sql_has_its_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
