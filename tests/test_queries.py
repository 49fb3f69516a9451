"""Every query with SQL agrees with DuckDB; the others give rows with a stable schema."""

import oracle
import pytest
from gristmill.plans import catalog

CON = oracle.connect()
#: DuckDB takes a minute for these; the driver compares them.
SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - SLOW))
def test_against_sql(spark, name):
    assert oracle.differences(catalog.QUERIES[name](spark, oracle.DATA), catalog.ORACLE[name], CON) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0
