"""Every registered query that SQL can express, against DuckDB over the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from memspark import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(name, spark, duck):
    df = catalog.QUERIES[name](spark, DIR)
    result = duck.execute(catalog.ORACLE_SQL[name])
    expected = table_of([d[0] for d in result.description], result.fetchall())
    assert table_of(df.columns, df.collect()) == expected
