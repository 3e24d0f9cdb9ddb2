"""Ranks of rows in a total order, without ever sorting a group in one task.

An order by a well-spread key is cut into buckets of bounded size. The counts of the
buckets, summed up, give each bucket the rank of its first row; ranks inside a bucket
need its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's rank from 1 within ``group``, by ``bucket`` and then
    ``order``, and ``name_of``: the rows of its group. ``bucket`` must rise with the order and
    hold few enough rows in each value; there may be many values."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # The counts of coarser buckets first, so that summing up is itself split.
    counts = written(counts.withColumn("_coarse", F.shiftright("_b", 8)), "bucket-counts")
    within = Window.partitionBy(*group, "_coarse").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_cn"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    coarse = coarse.withColumns({
        "_before": F.coalesce(F.sum("_cn").over(over.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        f"{name}_of": F.sum("_cn").over(over),
    }).drop("_cn")
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    starts = _match(starts, coarse, [*group, "_coarse"], "_c").withColumn("_start", F.col("_before") + F.col("_in"))
    starts = written(starts.select(*group, "_b", "_start", f"{name}_of"), "bucket-starts")
    own = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    out = _match(df.withColumn("_own", own), starts, [*group, "_b"], "_s")
    return out.withColumn(name, F.col("_start") + F.col("_own")).drop("_b", "_own", "_start")


def _match(left: DataFrame, right: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """An inner join on keys of which nulls match."""
    right = right.withColumnsRenamed({k: f"{mark}{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys]
    return left.join(right, on).drop(*[f"{mark}{k}" for k in keys])
