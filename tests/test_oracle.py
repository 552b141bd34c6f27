"""Every query with SQL gives DuckDB's rows. $TEST_SF names other tables than the smallest."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glossa.plans import catalogue

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that compares equal across engines: numbers rounded to nine digits, containers as tuples."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, dict):
        return str([(plain(k), plain(x)) for k, x in sorted(v.items())])
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert entry.queries()[name](spark, SF).count() > 0, name
