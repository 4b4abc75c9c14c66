"""Every registered query of the package against its SQL, on the smallest tables."""

import pytest
from conftest import same_as_sql

from tessera import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, duck):
    same_as_sql(QUERIES[name](spark, sf), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
