"""Every reference query against its oracle, and that the comparison can fail."""

import pytest

from tests.compare import database, same
from tests.conftest import DATA
from terrasift.plans import registry


@pytest.fixture(scope="module")
def con():
    return database(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, con, name):
    found = registry.QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
    assert same(found, con.execute(registry.ORACLE_SQL[name]).df())


def test_comparison_tells_a_wrong_query(spark, con):
    found = registry.QUERIES["distinct_rows"](spark, str(DATA / "sf0.001")).limit(3).toPandas()
    assert not same(found, con.execute(registry.ORACLE_SQL["distinct_rows"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
