"""Queries with SQL give its rows."""

import pytest

from orbiteer.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, same_rows, name):
    same_rows(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])
