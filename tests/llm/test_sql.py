"""Corpus queries against their SQL, all rows."""

import parity
import pytest

from pairwright.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert parity.compare(spark, parity.connect(SF), queries.queries()[name], SQL[name], SF) > 0
