"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from tests.conftest import canonical
from tidemark import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, oracle, name):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(oracle(SQL[name]))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    different = (got != want).any(axis=1)
    assert not different.any(), f"\n{got[different].head(3)}\n{want[different].head(3)}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
