"""Set operations and changes by key reach every part, at any size of the table."""

import pytest

from loam.plans.queries import QUERIES

#: Rows of each query over n parts of which k have sizes below 20, keys 0 to n - 1; half of the changes' keys exist.
ROWS = {
    "union": lambda n, k: n + k, "union_all": lambda n, k: 2 * n, "bind_rows": lambda n, k: 2 * n, "intersect": lambda n, k: n - k, "setdiff": lambda n, k: k, "symdiff": lambda n, k: 2 * k,
    "rows_update": lambda n, k: n, "rows_patch": lambda n, k: n, "rows_insert": lambda n, k: n + n // 2, "rows_append": lambda n, k: 2 * n, "rows_upsert": lambda n, k: n + n // 2, "rows_delete": lambda n, k: n // 2,
}


@pytest.mark.parametrize("name", list(ROWS))
def test_all_parts_take_part(spark, name):
    sf_dir = "/root/testdata/sf0.01"  # has ten times the parts that ids up to 200 reach
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, k = part.count(), part.filter("p_size < 20").count()
    assert n == 2000 and part.agg({"p_partkey": "max"}).first()[0] == n - 1
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == ROWS[name](n, k)
    assert got.filter("p_partkey > 200").count() > 0
