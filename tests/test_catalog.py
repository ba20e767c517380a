"""Queries that SQL cannot state run on the smallest tables; the others are compared with their SQL by ``tools/compare.py``."""

import pytest

from playmetrics.catalog import QUERIES, SQL

#: Six folds of 250 trees each; `test_tables` runs the same operators on planted data.
LONG = {"classify_users", "classify_users_balanced", "random_forest_folds"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_query_runs(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.columns and len(found.collect()) > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
