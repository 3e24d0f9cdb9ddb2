"""The queries opN_<name>: each operator over its whole table, with production parameters,
and DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql
from .html_extraction import extract
from .line_dedup import line_dedup
from .media import text_media
from .minhash_dedup import minhash_dedup
from .mixing import mix
from .pieces import encode
from .quality_rules import quality_rules
from .shared import documents
from .sharding import stratified_shards
from .substring_dedup import substring_dedup
from .toxicity import toxicity

QUERIES = {
    "op1_substring_dedup": lambda spark, sf_dir: substring_dedup(documents(spark, sf_dir)),
    "op2_line_dedup": lambda spark, sf_dir: line_dedup(documents(spark, sf_dir)),
    "op3_media_columns": lambda spark, sf_dir: text_media(documents(spark, sf_dir)),
    "op4_quality_rules": lambda spark, sf_dir: quality_rules(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 9)),
    "op5_toxicity": lambda spark, sf_dir: toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    .select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages")),
    "op6_mixing": lambda spark, sf_dir: mix(documents(spark, sf_dir)),
    "op7_html_extraction": lambda spark, sf_dir: extract(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op8_stratified_shards": lambda spark, sf_dir: stratified_shards(documents(spark, sf_dir)),
    "op9_sampled_pieces": lambda spark, sf_dir: encode(documents(spark, sf_dir)),
    "op10_minhash_dedup": lambda spark, sf_dir: minhash_dedup(documents(spark, sf_dir)),
}
ORACLE = {name: query for name, query in sql.ORACLE.items() if name in QUERIES}
