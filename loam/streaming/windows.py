"""Windows over event time, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, tidy
from ..functions import expr as E


def windowed(data: Any, time: str, every: str, *, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = (), **summaries: E.Expr) -> DataFrame:
    """Summaries by tumbling or sliding windows and keys; rows later than ``late`` are dropped,
    which lets a stream forget old windows."""
    f = tidy(data)
    df = f.df.withWatermark(time, late) if late else f.df
    c = E.Context(df, aggregate=True)
    w = F.window(E.quoted(time), every, slide) if slide else F.window(E.quoted(time), every)
    out = df.groupBy(w.alias("window"), *[E.quoted(k) for k in by]).agg(*[E.lit(v)(c).alias(k) for k, v in summaries.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[E.quoted(k) for k in by], *[E.quoted(k) for k in summaries])


def sessions(data: Any, time: str, gap: str, *, late: str | None = None, by: tuple[str, ...] = (), **summaries: E.Expr) -> DataFrame:
    """Summaries by sessions: runs of a key's rows no further apart than ``gap``."""
    f = tidy(data)
    df = f.df.withWatermark(time, late) if late else f.df
    c = E.Context(df, aggregate=True)
    out = df.groupBy(F.session_window(E.quoted(time), gap).alias("session"), *[E.quoted(k) for k in by]).agg(*[E.lit(v)(c).alias(k) for k, v in summaries.items()])
    return out.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *[E.quoted(k) for k in by], *[E.quoted(k) for k in summaries])


def each_batch(stream: DataFrame, pipeline: Callable[[Frame], Frame], path: str, checkpoint: str) -> Any:
    """Runs a pipeline on each micro-batch and adds its result to a Parquet table; all verbs
    may be used, as a batch is an ordinary table."""

    def write(df: DataFrame, epoch: int) -> None:
        pipeline(tidy(df)).to_spark().write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
