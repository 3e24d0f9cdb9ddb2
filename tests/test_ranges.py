"""Joins by ranges without a key, over whole tables and against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam import api as t
from loam.operators import joins
from loam.plans.queries import QUERIES


def test_the_overlap_join_holds_all_parts(spark, sf_dir):
    parts = [(r.p_partkey, r.p_size) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    want = Counter((a, b) for a, x in parts for b, y in parts if x <= y + 1 and x + 1 >= y)
    assert Counter(map(tuple, QUERIES["overlaps_join"](spark, sf_dir).collect())) == want


RANGES = {
    "overlaps": (t.overlaps("a", "b", "c", "d"), lambda a, b, c, d: a <= d and b >= c),
    "open": (t.overlaps("a", "b", "c", "d", bounds="()"), lambda a, b, c, d: a < d and b > c),
    "within": (t.within("a", "b", "c", "d"), lambda a, b, c, d: a >= c and b <= d),
    "between": (t.between("a", "c", "d"), lambda a, b, c, d: c <= a <= d),
}
KINDS = {
    "long": lambda x: round(x),
    "double": lambda x: x / 7,
    "date": lambda x: dt.date(1999, 1, 1) + dt.timedelta(days=round(x / 10)),
    "timestamp": lambda x: dt.datetime(1969, 12, 31) + dt.timedelta(seconds=x),
    "timestamp_ntz": lambda x: dt.datetime(1969, 12, 31) + dt.timedelta(seconds=x),
}


@pytest.mark.parametrize("name", list(RANGES))
@pytest.mark.parametrize("kind", list(KINDS))
def test_ranges_without_a_key_are_joined_by_buckets(spark, name, kind):
    r = random.Random(f"{name}{kind}")

    def side():
        out = []
        for _ in range(80):
            low = r.uniform(-2000, 2000)
            pair = [KINDS[kind](low), KINDS[kind](low + r.choice([0, 1, 30, 900, 40_000, -5]) * r.random())]
            out.append(tuple(None if r.random() < 0.05 else v for v in pair))
        return out

    x, y = side(), side()
    by, holds = RANGES[name]
    left, right = spark.createDataFrame(x, f"a {kind}, b {kind}"), spark.createDataFrame(y, f"c {kind}, d {kind}")
    out = (t.tidy(left) >> t.inner_join(right, by=t.join_by(by))).to_spark()
    need = 3 if name == "between" else 4
    ok = lambda p, q: None not in ([p[0], *q] if need == 3 else [*p, *q]) and holds(*p, *q)
    assert Counter(map(tuple, out.collect())) == Counter((*p, *q) for p in x for q in y if ok(p, q))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extreme_values_and_names_of_range_columns(spark):
    inf, nan = float("inf"), float("nan")
    x = [(1, -inf, 0.0), (2, 5e-324, 1e-300), (3, nan, nan), (4, 1e308, inf), (5, 2.0, 2.0)]
    y = [(1, 0.0, 0.0), (2, 1e-310, 1e308), (3, -inf, inf), (4, 2.0, nan)]
    left, right = spark.createDataFrame(x, "level int, `from` double, bucket double"), spark.createDataFrame(y, "at int, first double, `to` double")
    out = t.tidy(left) >> t.inner_join(right, by=t.join_by(t.overlaps("from", "bucket", "first", "to"))) >> t.select("level", "at")
    want = left.join(right, (left["from"] <= right["to"]) & (left["bucket"] >= right["first"])).select("level", "at")
    assert sorted(map(tuple, out.to_spark().collect())) == sorted(map(tuple, want.collect()))


def test_tasks_share_the_pairs_of_a_crowded_bucket(spark):
    left, right = spark.range(40_000, numPartitions=1).selectExpr("id a", "7 lo", "8 hi"), spark.range(500, numPartitions=1).selectExpr("id b", "8 start", "9 end")
    out = (t.tidy(left) >> t.inner_join(right, by=t.join_by(t.overlaps("lo", "hi", "start", "end"))) >> t.select("a", "b")).to_spark()
    shares = [(r["n"], r["a"], r["b"]) for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()]
    assert [sum(x) for x in zip(*shares, strict=True)] == [20_000_000, 500 * sum(range(40_000)), 40_000 * sum(range(500))]
    assert len(shares) > 1 and max(n for n, *_ in shares) < 0.7 * 20_000_000


@pytest.mark.parametrize("name", list(RANGES))
@pytest.mark.parametrize("task_pairs", [2000, 2**24])
def test_blocks_hold_each_pair_once(spark, monkeypatch, name, task_pairs):
    monkeypatch.setattr(joins, "BLOCK", 20)
    monkeypatch.setattr(joins, "TASK_PAIRS", task_pairs)
    r = random.Random(name)
    x, y = ([(i, *sorted((r.choice([1, 1, 1, 2, 3, 60]), r.choice([1, 1, 2, 3, 90])))) for i in range(n)] for n in (150, 90))
    by, holds = RANGES[name]
    left, right = spark.createDataFrame(x, "i int, a int, b int"), spark.createDataFrame(y, "j int, c int, d int")
    out = t.tidy(left) >> t.inner_join(right, by=t.join_by(by)) >> t.select("i", "j")
    assert Counter(map(tuple, out.to_spark().collect())) == Counter((i, j) for i, *p in x for j, *q in y if holds(*p, *q))
