"""Shards that all hold the same mixture of sources, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .shared import pick, written

#: Hex digits of the shuffling hash that make a bucket: 65,536 for each source.
DIGITS = 4
#: Buckets of the fractional rank.
STEPS = 1 << 16


def stratified_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 8, seed: str = "loam") -> DataFrame:
    """Proportional stratified interleaving. Rows are shuffled within their source by a seeded
    hash and ranked; the rank of the r-th of n rows is put at (2r - 1) / 2n; all rows sorted
    by that fraction are cut into ``shards`` runs whose lengths differ by one at most. Each
    run so holds every source in proportion, to within a row or so.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law (rows), shard
    (from 0), slot (from 0 within the shard, gapless) and grown_shard (null: this law
    promises nothing for another number of shards).

    Null texts have no bytes. Rows without a source are one source, rows without an id are
    shuffled as if their id were the empty text, and rows that repeat an id, which tie, are
    told apart by the checksum and size of their texts; those equal in all of it are
    interchangeable. The shuffle is by a hash of id and text checksum, so that a group of
    rows with one id is still spread unless the texts agree too. An empty table gives an
    empty result. Other columns are ignored.
    """
    table = pick(docs, doc_id=doc_id, source=source, text=text)
    text_ = F.coalesce("text", F.lit(""))
    table = table.select("doc_id", "source", (F.octet_length(text_) + F.lit(1)).cast("long").alias("size"), F.crc32(text_.cast("binary")).alias("text_crc32"))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32").cast("string")))
    table = written(table.withColumn("key", key), "shuffled")
    bucket = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("int")
    ties = [F.col("key"), F.col("size")]
    table = ranked(table, ["source"], bucket, ties, "rank")
    part = (2 * F.col("rank") - 1) / (2 * F.col("rank_of"))
    table = written(table.withColumn("part", part).drop("rank", "rank_of"), "fractions")
    table = ranked(table, [], F.floor(F.col("part") * STEPS).cast("int"), [F.col("part"), F.col("source").asc_nulls_last(), *ties], "place")
    # shard s takes the places from s * n div shards on, places counted from 0
    table = table.withColumn("shard", F.expr(f"(place * {shards} - 1) div place_of"))
    first = F.expr(f"shard * place_of div {shards}")
    return table.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - 1 - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
