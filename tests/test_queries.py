"""Every query of the tidy verbs against DuckDB."""

from collections import Counter

import duckdb
import pytest

from loam.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).to_arrow_table()
        if name in ("slice_sample", "group_modify") and not got.num_rows:
            pytest.skip("no rows at this size")
        assert rows(got) == rows(want)
