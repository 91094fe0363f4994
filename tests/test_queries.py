"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rangeledger.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(str(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, SMALL)
    want = oracle.sql(SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
