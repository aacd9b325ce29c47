"""Every relational query against DuckDB on the same tables; none may be empty."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from gritstone import queries, queries_engine, queries_records

DATA = "/root/testdata/sf0.01"
NAMES = sorted(queries.QUERIES | queries_engine.QUERIES | queries_records.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, Decimal) else str(v) if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    answer = duck.sql(entry.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    place = [answer.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in answer.fetchall()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    entry.queries()["tpch_q06"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "l_comment" not in plan
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "l_partkey" not in schema and "l_extendedprice" in schema
