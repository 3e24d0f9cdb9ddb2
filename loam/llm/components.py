"""Connected components of a graph in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long), u != v, in any direction, repeats allowed. Returns node and
    component, its least node, for every node of an edge.

    Alternates large-star and small-star steps, which turn every component into a star
    around its least node in a number of rounds that is logarithmic in practice. Every round is written
    to the shared folder; the driver sees only a count and a checksum.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e = written(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).filter("u != v").distinct()
        e = written(small, "small-star")
        now = _state(e)
        if now == before:
            break
        before = now
    tips = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tips.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
