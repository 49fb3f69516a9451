"""The corpus queries that have SQL agree with DuckDB."""

import oracle
import pytest
from gristmill.llm import catalog

CON = oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    assert oracle.differences(catalog.QUERIES[name](spark, oracle.DATA), catalog.ORACLE[name], CON) == []
