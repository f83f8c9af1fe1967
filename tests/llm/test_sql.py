"""The registered queries against their SQL."""

import pytest
from compare import difference

from palimpsest.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    assert difference(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name]) is None
