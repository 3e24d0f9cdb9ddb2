"""What the operators of this subpackage share: reading columns safely and writing
intermediate tables to the folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_FOLDER = "/tmp/checkpoints/loam"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, new="old")`` selects columns by their exact names, whatever else the
    table holds: other columns may differ from them by case only, or clash with the
    names that an operator adds."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. If that is unset, one of our own, and on
    a cluster, whose executors wouldn't see it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or OWN_FOLDER).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as the cluster has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and a
    lost executor costs no more than a reread. Spark's JVM removes it when it exits, or
    dropped() before. ``by``: a column of few values, each of which gets its own files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    to = df.write.option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    place, files = file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() returned and that nothing reads any more."""
    for table in tables:
        place, files = file_system(table.sparkSession, table._written)
        files.delete(place, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
