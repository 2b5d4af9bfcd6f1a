"""Every registered query against its SQL counterpart, on the smallest tables."""

import math

import duckdb
import pytest

from rowtide.plans.oracle import ORACLE
from rowtide.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    frame = QUERIES[name](spark, SF)
    expected = sql.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    found = plain([tuple(r) for r in frame.collect()], frame.columns)
    assert found and found == plain(expected.fetchall(), expected.columns)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0 and set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())
