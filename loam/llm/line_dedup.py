"""Removal of lines that many documents hold.

Line keys live in levelled, sorted runs, as in a log-structured merge tree. A batch of
documents is first anti-joined by merge with the keys that runs have decided already,
and what is left is written as a new sorted run with its document counts. When a level
holds ``fan_in`` runs they are merged into one run of the next level, which adds up
the counts and so decides more keys. Runs are bucketed and sorted by key on disk, so only
the new batch is shuffled and sorted; a key is never looked up one by one, and old runs
are rewritten a logarithmic number of times.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import file_system, pick, shared_folder, written
from .words import buffers, frugal

BLANKS = b" \t\n\v\f\r"


def _keys(raw: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None for a line whose key is too short to count."""
    out = []
    for line in raw.split(b"\n"):
        key = line.strip(BLANKS).lower()  # of bytes: A to Z only
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, at = buffers(column)
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _emit(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = [], []
            for i, raw in enumerate(_texts(batch.column(2))):
                found = dict.fromkeys(k for k in _keys(raw, min_chars) if k)
                keys += found
                own += [i] * len(found)
            own = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(own), pa.array(keys, pa.binary()), batch.column(0).take(own)], names=["j", "key", "batch"])

    return run


def _rewrite(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, sha, texts = [], [], [], []
            for raw, gone in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                parts = raw.split(b"\n")
                lines.append(len(parts))
                if gone:
                    gone = set(gone)
                    parts = [x for x, key in zip(parts, _keys(raw, min_chars), strict=True) if key not in gone]
                dropped.append(lines[-1] - len(parts))
                kept = b"\n".join(parts)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [*batch.columns[2:], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


@dataclass
class Run:
    """A sorted run: a table of (key, n) in buckets by key, each one file in the keys' order."""

    name: str
    path: str


class LineRuns:
    """Levelled sorted runs of (key, n): line keys and the documents that hold them.

    All runs have the same ``buckets``, by default as many as the session has shuffle
    partitions, so they are merged and anti-joined bucket by bucket, without a shuffle or
    sort of what they hold. Given a ``path`` in a shared folder, they stay there, and a later
    LineRuns of the same path goes on with them; else they last as long as Spark's JVM.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2, buckets: int | None = None, path: str | None = None):
        if fan_in < 2:
            raise ValueError("fan_in must be 2 or more")
        self.spark, self.min_docs, self.fan_in, self.path = spark, min_docs, fan_in, path
        self.levels: list[list[Run]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._version = 0
        if path and (held := self._manifest()):
            if buckets not in (None, held["buckets"]):
                raise ValueError(f"the runs in {path} have {held['buckets']} buckets")
            self.buckets, self._version = held["buckets"], held["version"]
            self.levels = [[self._opened(Run(**x)) for x in level] for level in held["levels"]]

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def read(self, run: Run) -> DataFrame:
        return self.spark.table(run.name)

    def add(self, keys: DataFrame) -> None:
        """keys: a row for each document and key of one batch."""
        with self._merging():
            new = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            for run in self.runs():
                new = new.join(self.read(run).filter(F.col("n") >= self.min_docs).hint("merge"), "key", "left_anti")
            self._put(0, new)
        if self.path:
            self._keep()

    def decided(self) -> DataFrame:
        """The keys that at least ``min_docs`` documents hold."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary")
        with self._merging():
            return written(self._summed(self.runs()).filter(F.col("n") >= self.min_docs).select("key"), "decided-lines")

    def _summed(self, runs: list[Run]) -> DataFrame:
        """One sorted run of several, merged two by two."""
        return reduce(
            lambda a, b: a.join(b.hint("merge").toDF("key", "m"), "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")),
            [self.read(run) for run in runs],
        )

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        path = f"{self.path or shared_folder(self.spark)}/{name}"
        if not self.path:
            place, files = file_system(self.spark, path)
            files.deleteOnExit(place)
        run.select("key", "n").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.levels[level].append(Run(name, path))
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._summed(full))
            for old in full:
                self.spark.sql(f"DROP TABLE {old.name}")
                if not self.path:  # kept runs stay until the manifest no longer names them
                    place, files = file_system(self.spark, old.path)
                    files.delete(place, True)

    @contextmanager
    def _merging(self) -> Iterator[None]:
        """As many shuffle partitions as there are buckets, and scans that know their order."""
        settings = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true"}
        before = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _opened(self, run: Run) -> Run:
        if not self.spark.catalog.tableExists(run.name):
            self.spark.sql(f"CREATE TABLE {run.name} (key BINARY, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{run.path}'")
        return run

    def _manifest(self) -> dict | None:
        """The last state that was written in full."""
        place, files = file_system(self.spark, f"{self.path}/manifest-*.json")
        found = sorted(str(x.getPath()) for x in files.globStatus(place) or [])
        return json.loads(self.spark.read.text(found[-1]).first()[0]) if found else None

    def _keep(self) -> None:
        """A new manifest, under its name only once it is whole; then what it doesn't name goes."""
        self._version += 1
        state = {"version": self._version, "buckets": self.buckets, "levels": [[vars(run) for run in level] for level in self.levels]}
        draft, files = file_system(self.spark, f"{self.path}/draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = file_system(self.spark, f"{self.path}/manifest-{self._version:09d}.json")
        if not files.rename(draft, final):
            raise OSError(f"{final} exists: two writers at once?")
        named = {final.getName(), *(run.name for run in self.runs())}
        for x in files.listStatus(file_system(self.spark, self.path)[0]):
            if x.getPath().getName() not in named:
                files.delete(x.getPath(), True)


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 2, with_text: bool = False, carry: Sequence[str] = (), runs: LineRuns | None = None
) -> DataFrame:
    """Drops all lines whose key is held by at least ``min_docs`` documents.

    A text's lines are what \\n separates; a key is a line without blanks at its ends and
    with A to Z in lower case, and counts from ``min_chars`` code points on. Documents
    arrive in ``batches``, dealt by a hash of their ids. Returns doc_id, the columns named
    in ``carry``, n_lines, n_dropped, kept_sha256 and, ``with_text``, the kept lines.

    ``runs``: runs of earlier calls, whose documents count with these; they get these
    documents' keys, and their own ``min_docs`` and ``fan_in`` hold.

    Null and empty texts have one empty line, which has no key. Every row counts as one
    document, also one that repeats an id or lacks one; each keeps its own result. A line
    repeated in one document counts once. Very long texts are handled whole. An empty
    table gives an empty result. Other columns are ignored.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be 1 or more")
    named = {f"c{i}": c for i, c in enumerate(carry)}
    table = pick(docs, doc_id=doc_id, text=text, **named)
    table = table.withColumn("j", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    dealt = table.select(F.pmod(F.xxhash64("j"), F.lit(batches)).cast("int").alias("batch"), "j", "text")
    lines = written(dealt.mapInArrow(frugal(_emit(min_chars)), "j long, key binary, batch int"), "lines", by="batch")
    runs = runs or LineRuns(docs.sparkSession, min_docs, fan_in)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("key"))
    # A line that a third of the documents hold is one key here: Spark splits it by its rows.
    gone = lines.join(runs.decided(), "key", "left_semi")
    gone = gone.groupBy("j").agg(F.collect_set("key").alias("gone"))
    joined = table.join(gone, "j", "left").select("text", "gone", "doc_id", *named)
    fields = [T.StructField(c, table.schema[a].dataType) for a, c in (("doc_id", "doc_id"), *named.items())]
    fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.StringType())] * with_text
    return joined.mapInArrow(frugal(_rewrite(min_chars, with_text)), T.StructType(fields))
