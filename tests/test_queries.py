"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from jobs import registered as jobs
from passagework.plans import registered

QUERIES, ORACLES = {**registered.QUERIES, **jobs.QUERIES}, {**registered.ORACLES, **jobs.ORACLES}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as from read_parquet('{SF}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((plain(r) for r in want.fetchall()), key=repr)
    spark.catalog.clearCache()


@pytest.mark.parametrize("lost", ["corpus_pipeline", "passagework.llm"])
def test_core_queries_are_registered_without_the_optional_part(monkeypatch, lost):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, lost, None)
    assert set(entry.queries()) == set(QUERIES) and entry.oracle_sql() == ORACLES
