import pytest

from lexmill.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
