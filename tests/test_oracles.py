"""Every query of the reference's operators against its oracle, on the smallest tables."""

import pytest

from strandline.plans import registry
from tests.compare import check, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    check(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_oracle(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
