"""Registered queries of the footage engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from cutgrain.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    fix = lambda x: round(float(x), 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(fix(r[c]) for c in columns)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, sf, name):
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
