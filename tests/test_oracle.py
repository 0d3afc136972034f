"""Every registered query of the archive's operators against its SQL twin."""

from __future__ import annotations

import pytest
from compare import connection, differences

from fieldmark.queries import registry

DATA = "/root/testdata/sf0.01"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), ORACLE[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
