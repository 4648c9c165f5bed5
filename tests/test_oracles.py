import pytest

from telequay import plans

from .oracle import assert_equal

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert_equal(spark, plans.queries()[name], plans.oracle_sql()[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
