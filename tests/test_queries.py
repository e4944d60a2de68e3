"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

import pytest

from evigrain import plans
from tests.compare import rows


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, small, name):
    got, want = rows(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], small)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
