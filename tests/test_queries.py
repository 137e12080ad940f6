"""Every query against its SQL, on the smallest tables."""

import pytest
from compare import duck_rows, rows

from palimpsest.plans.queries import QUERIES, SQL
from palimpsest.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, name):
    columns, got = rows(QUERIES[name](spark, SF))
    want_columns, want = duck_rows(SQL[name], SF)
    assert columns == want_columns
    assert got == want
    assert got


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["session_id", "recommended"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tifu_neighbors_exact_all", "metrics_hit_all", "base_tifu_knn_euclid_all"])
def test_all_users_are_queries(spark, name):
    users = {r.user_id for r in tables.baskets(spark, SF).groupBy("user_id").count().filter("count > 1").select("user_id").collect()}
    assert users <= {r.user_id for r in QUERIES[name](spark, SF).select("user_id").distinct().collect()}
