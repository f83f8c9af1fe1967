"""Every registered query equals its SQL on the smallest test tables."""

import os

import pytest
from compare import difference

from palimpsest.plans.registry import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, name):
    assert difference(spark, SF, all_queries()[name], all_sql()[name]) is None
