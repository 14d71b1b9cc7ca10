"""The package's queries against SQL, and that all of them run."""

import pytest
from conftest import compare

from brinework.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tables, name):
    assert queries.queries()[name](spark, tables()).count() == 0
