"""Every query of the llm problems on the smallest tables, beside its SQL where it has one."""

import pytest
from verify import compare

from annalist.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    rows, equal, why = compare(spark, name, SF)
    assert equal is not False, why
    assert rows >= 0
