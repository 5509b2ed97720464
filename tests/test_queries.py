"""Every core query beside its SQL on the smallest tables."""

import pytest
from verify import compare

from annalist.plans import catalog, problems, service

SF = "/root/testdata/sf0.001"
NAMES = [*catalog.QUERIES, *service.QUERIES, *problems.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    rows, equal, why = compare(spark, name, SF)
    assert equal is not False, why
    assert rows >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
