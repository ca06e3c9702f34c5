"""Every registered query with oracle SQL equals DuckDB on the same Parquet tables."""

from __future__ import annotations

import pytest

from rankspark.plans.catalog import load_all
from rankspark.plans.compare import compare, duckdb_connection

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql is not None)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_connection(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, sf_dir, name):
    q = REG[name]
    r = compare(spark, con, name, q.build, q.sql, sf_dir)
    assert r["ok"], r.get("reason")
    assert r["spark_rows"] > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    ops = {op for q in REG.values() for op in q.ops}
    for family in ("PF-", "JN-", "AG-", "WN-", "SL-", "SO-", "SC-", "ML-"):
        assert any(op.startswith(family) for op in ops), family


def test_every_query_lists_operators():
    for name, q in REG.items():
        assert q.ops, name
