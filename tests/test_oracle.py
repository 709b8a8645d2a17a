"""Every core query with SQL gives the same rows as its SQL."""

import pytest
from oracle import compare, connect

from corpusloom.plans import registries

QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, con, name):
    got, want, extra, missing = compare(spark, con, small, QUERIES[name], SQL[name])
    assert not extra and not missing, (got, want, extra, missing)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
