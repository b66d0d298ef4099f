"""Every query with SQL against that SQL; every query without runs and has rows or a schema."""

import parity
import pytest

from pairwright.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    f = registry.queries()[name]
    if name in SQL:
        parity.compare(spark, con, f, SQL[name], SF)
    else:
        assert f(spark, SF).columns
