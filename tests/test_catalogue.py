import pytest
from compare import compare, duck

from hoptrail.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, con, name):
    assert compare(spark, con, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "event_id", "low_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
