"""A corpus from raw documents to sampled pieces, in stages that each work on all that the
one before kept. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.line_dedup import line_dedup
from loam.llm.minhash_dedup import minhash_dedup
from loam.llm.mixing import mix
from loam.llm.pieces import encode
from loam.llm.shared import pick, written
from loam.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _whole(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever others there are and however they are written."""
    return pick(docs, **{c: c for c in COLUMNS})


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, as they were.

    Null and empty texts are scored as texts without words, rows without an id like any
    others. Rows that repeat an id are each scored. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(_whole(docs), labels, carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that ten or more of them hold; n_chars is counted anew.

    Null texts become empty ones; texts that lose all their lines stay as empty ones. Every
    row counts as one document, also one that repeats an id or lacks one. An empty table
    stays empty."""
    out = line_dedup(_whole(docs), with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id, and all that
    have none. Near-duplicates share 80 % of their sets of five-word sequences.

    Texts without words are in no group, and neither are rows without an id: they stay. Rows
    that repeat an id are one document, which stays or goes. An empty table stays empty."""
    docs = _whole(docs)
    gone = minhash_dedup(docs, shingle=5).filter("NOT kept").select("doc_id")
    return docs.join(written(gone, "near-duplicates"), "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, a row each time; those without words not
    at all.

    Rows that repeat an id within a source are taken alike, rows without an id too; rows
    without a source are one source. An empty table stays empty."""
    docs = _whole(docs)
    times = mix(docs, carry=("source",)).filter("taken > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.expr("taken div size").cast("int").alias("times"))
    times = written(times.distinct(), "times")
    out = docs.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, with digests of the ids and of the text that they
    decode to.

    Null and empty texts have no pieces. Rows that repeat an id and a text have the same
    pieces. An empty table gives an empty result."""
    return encode(_whole(docs), carry=("lang", "source"))


STAGES = [
    ("toxicity", clean),
    ("line dedup", without_common_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing to target weights", mixed),
    ("sampled pieces", sampled),
]
#: Trained scores and hash signatures can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
