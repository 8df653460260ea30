"""Queries with SQL against DuckDB, over whole tables."""

import pytest

from millrace.llm.oracles import oracle_sql
from millrace.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(same_as_duckdb, name):
    assert same_as_duckdb(queries()[name], oracle_sql()[name])
