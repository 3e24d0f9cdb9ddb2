"""Mixing sources to target weights by hash thresholds.

A document is taken when its hash lies below its source's threshold. Thresholds come from
histograms: tokens summed by source and hash bucket, and summed up until the budget is
reached. Only the bucket in which that happens is looked at again, in finer buckets, until
whole hashes are told apart. No documents are sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, written

#: Hex digits of the hash: in all, and resolved in each refinement.
DIGITS, STEP = 15, 5


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target.

    The budget, ``share`` of all sizes, is shared by weight; no target exceeds ``most`` times
    its source's size, and what is over goes to the rest by weight. That is the level L with
    sum(min(weight * L, most * size)) = budget: sources fill up in the order of
    most * size / weight, so running sums in this order give L directly.
    """
    by_name = Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    one = sizes.withColumn("one", F.lit(1))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = reduce(lambda c, i: c.when(place == i, weights[i]), range(1, len(weights)), F.when(place == 0, weights[0]))
    one = one.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy("one")
    filled = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumns({
        "budget": share * F.sum("source_size").over(every),
        "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0)),
        "full": F.coalesce(F.sum("cap").over(filled), F.lit(0.0)),
    })
    # the level at which this source fills up is reached if the budget lasts that far
    level = (F.col("budget") - F.col("full")) / F.col("rest")
    one = one.withColumn("level", F.when(F.col("cap") / F.col("weight") > level, level))
    level = F.max("level").over(every)  # of the first source that does not fill up
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * level)
    return one.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "loam", carry: tuple[str, ...] = ()) -> DataFrame:
    """Takes documents so that each source's words come near its target. Returns doc_id, size
    (words), the columns named in ``carry``, source_size, target and taken: the words that the mix takes, as often as whole
    documents are repeated, at most ``most`` times their size.

    Sources in the order of their code points, null last, have ``weights`` in turn and share
    ``share`` of all sizes. Whole rounds of a source are taken first; the rest of its target
    takes the documents below the hash threshold once more, as many as fit.

    Null and empty texts have size 0 and are taken as nothing. Rows without a source are one
    source; sources are few enough for one task to order them. Rows without an id hash as if it were the empty text; rows that repeat an id
    are taken alike. Ties of the whole hash are taken or left together. An empty table
    gives an empty result. Other columns are ignored.
    """
    named = {f"c{i}": c for i, c in enumerate(carry)}
    table = pick(docs, doc_id=doc_id, source=source, text=text, **named)
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, DIGITS), 16, 10).cast("long")
    table = written(table.select("doc_id", "source", key.alias("key"), word_count("text").alias("size"), *named), "sizes")
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    rounds = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    goal = goal.withColumn("rounds", F.when(F.col("source_size") > 0, rounds).otherwise(0))
    # below: hashes under it are within the budget; left: what the budget still has for the boundary bucket, from below on
    state = goal.select(F.col("source").alias("s"), "source_size", "target", "rounds", F.lit(0).cast("long").alias("below"), (F.col("target") - F.col("rounds") * F.col("source_size")).alias("left"))
    state = written(state, "thresholds")
    same = F.col("source").eqNullSafe(F.col("s"))
    for done in range(STEP, DIGITS + 1, STEP):
        wide, bucket = 1 << 4 * (DIGITS - done + STEP), 1 << 4 * (DIGITS - done)
        boundary = table.join(state.select("s", "below", "left"), same).filter((F.col("key") >= F.col("below")) & (F.col("key") < F.col("below") + wide))
        histogram = boundary.groupBy("s", "below", "left", F.expr(f"(key - below) div {bucket}").cast("int").alias("b")).agg(F.sum("size").alias("n"))
        # sums over coarse buckets first, then inside the coarse bucket where the budget ends
        running = Window.partitionBy("s", "c").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        histogram = written(histogram.withColumn("c", F.shiftright("b", 2 * STEP)), "histogram")
        coarse = histogram.groupBy("s", "c").agg(F.sum("n").alias("cn"))
        before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        coarse = coarse.withColumn("cb", F.coalesce(F.sum("cn").over(before), F.lit(0))).withColumnsRenamed({"s": "s2", "c": "c2"}).drop("cn")
        fine = histogram.join(coarse, F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("c2")))
        fine = fine.withColumn("sum", F.col("cb") + F.sum("n").over(running))
        over = fine.filter(F.col("sum") > F.col("left")).groupBy("s").agg(F.min_by(F.struct("b", (F.col("sum") - F.col("n")).alias("before")), "b").alias("e"))
        over = over.select(F.col("s").alias("s3"), "e")
        state = state.join(over, F.col("s").eqNullSafe(F.col("s3")), "left")
        state = written(state.select(
            "s", "source_size", "target", "rounds",
            # a budget that no bucket exceeds takes all of them
            F.when(F.col("e").isNotNull(), F.col("below") + F.col("e.b").cast("long") * bucket).otherwise(F.col("below") + wide).alias("below"),
            F.when(F.col("e").isNotNull(), F.col("left") - F.col("e.before")).otherwise(F.col("left")).alias("left"),
        ), "thresholds")
    out = table.join(state, same)
    times = F.col("rounds") + (F.col("key") < F.col("below")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.least(times, F.lit(most))).cast("long").alias("taken"), *[F.col(a).alias(c) for a, c in named.items()])
