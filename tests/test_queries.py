"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math

import pytest

from strataquery.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in names] for r in frame.collect()), key=str)
    found = duck.sql(SQL[name])
    place = [found.columns.index(c) for c in names]
    want = sorted(([plain(r[i]) for i in place] for r in found.fetchall()), key=str)
    assert sorted(found.columns) == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    assert frame.columns and frame.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8


def test_results_have_plain_types(spark, sf):
    for name in SQL:
        assert not any(kind.startswith(("array", "map", "struct")) for _, kind in QUERIES[name](spark, sf).dtypes), name
