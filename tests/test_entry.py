"""The registered queries: every one runs, and equals its SQL twin on the smallest tables."""

import collections
import os

import pytest

import __spark_entry__ as entry
from quarry.plans import registry

duckdb = pytest.importorskip("duckdb")


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v)


def bag(rows):
    return collections.Counter(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert bag(tuple(r) for r in got.select(*columns).collect()) == bag(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"json_reports", "recommendations", "code_gate", "health_scores"}))
def test_query_runs(spark, small, name):
    registry.QUERIES[name](spark, small).count()
