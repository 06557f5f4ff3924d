"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from conftest import SF

QUERIES = entry_point.queries()
ORACLE = entry_point.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    a, b = entry_point.entry(spark), entry_point.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(repr, (row[c] for c in cols))) for row in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(map(repr, (row[i] for i in at))) for row in cur.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(name, spark):
    assert QUERIES[name](spark, SF).count() >= 0
