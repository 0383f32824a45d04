"""Every registered query against its SQL; those without SQL at least run."""

import pytest
from oracle import connect, same

from weftmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.SQL:
        got, want = same(spark, con, SF, registry.QUERIES[name], registry.SQL[name])
        assert got == want
    else:
        assert registry.QUERIES[name](spark, SF).collect() is not None


def test_entry_module_works_without_the_optional_part():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
