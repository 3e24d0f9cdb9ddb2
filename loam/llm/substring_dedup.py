"""Removal of long passages that occur earlier in the corpus.

The windows of ``window`` words are the edges of a De Bruijn graph of the corpus, whose
nodes are the runs of ``window - 1`` words between them. It is compacted in two steps.

Inside a text, neighbouring edges that share their minimizer (the least hash among their
inner ``seed``-word pieces) make one path before anything is shuffled, so a text of n words
sends about n / 7 rows rather than n. Joins keep the paths whose minimizer repeats and give
each the source coordinate at which it first occurs.

Between paths, the node at a path's end is nonbranching if whatever enters it leaves it the
same way: its degrees are aggregated over all occurrences of the path before and of the path
after it. A join of paths with their successors merges those that meet in such a node. As
all occurrences of a nonbranching path run side by side, its first coordinates are in a row,
and so merged paths are read off in their order, however long they are.

Where one minimizer has several different paths, which is where repeats begin and end, these
are taken apart into single edges and compared by two independent 64-bit hashes each.
Before a long span is removed, the digest of its words is compared with that of the words at
its source coordinate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, pick, written
from .words import buffers, chunks, frugal, grams, mix, ranges

PATHS = "h long, c long, doc_id long, at long, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Windows of a text that are looked at together.
PART = 1 << 18


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The place of the least of each ``wide`` neighbours, the first of equal ones."""
    at, size = np.arange(len(x)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while size * 2 <= wide:
        at = lower(at[:-size], at[size:])
        size *= 2
    return lower(at[: len(at) - (wide - size)], at[wide - size :]) if wide > size else at


def _paths(window: int, seed: int):
    """at: the start of the first of a path's n windows. A text of more than PART windows is
    cut there as well, which only splits paths."""
    wide = window - seed + 1
    if not 1 <= seed <= window:
        raise ValueError("seed must be from 1 to window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, words in chunks(batch.column(1)):
                one, two = words.hashes(), words.hashes(half=1)
                for lo in range(0, len(one) - window + 1, PART):
                    hi = min(lo + PART + window - 1, len(one))
                    pieces, whole = grams(one[lo:hi], seed), grams(two[lo:hi], window)
                    doc = np.searchsorted(words.first, np.arange(lo, hi), "right") - 1
                    starts = np.flatnonzero(doc[: len(whole)] == doc[window - 1 :])
                    if not len(starts):
                        continue
                    least = _least(pieces, wide)[starts]
                    new = np.ones(len(starts), bool)
                    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
                    cut = np.flatnonzero(new)
                    n = np.diff(np.append(cut, len(starts)))
                    first, last = starts[cut], starts[cut + n - 1]
                    with np.errstate(over="ignore"):
                        c = mix(whole[first] * np.uint64(0x9E3779B97F4A7C15) + mix(whole[last]) + n.astype(np.uint64))
                    own = doc[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pieces[least[cut]].view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[a:b][own].astype(np.int64)), pa.array(first + lo - words.first[own]), pa.array(n.astype(np.int32))],
                        names=["h", "c", "doc_id", "at", "n"],
                    )

    return run


def _joined(raw: bytes) -> tuple[list[bytes], bytes, np.ndarray]:
    """The words of a text, the words joined by one space, and where in that each starts."""
    words = raw.split()
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)), out=starts[1:])
    return words, b" ".join(words), starts


def _digest(text: bytes, starts: np.ndarray, at: int, n: int) -> bytes:
    """Of n words from word ``at`` on, of a text as _joined gives it."""
    return hashlib.blake2b(memoryview(text)[starts[at] : starts[at + n] - 1], digest_size=16).digest()


def _at_sources(window: int):
    """Of the paths that are taken apart (array column ``edges`` of at and n), the single
    windows with two independent hashes; of merged paths (``spans``), the digests of their
    words. The latter have a null w1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "digest", "doc_id", "at", "n"]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            edges, spans = batch.column(2), batch.column(3)
            for a, b, words in chunks(batch.column(1)):
                held = edges.slice(a, b - a)
                inner = held.flatten()
                n = inner.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.repeat(np.repeat(np.arange(b - a), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), n)
                inner = ranges(inner.field("at").to_numpy(zero_copy_only=False).astype(np.int64), n)
                place = inner + words.first[own]
                inside = place + window <= words.first[own + 1]  # else of an unlike row with the same id
                own, inner, place = own[inside], inner[inside], place[inside]
                if len(own):
                    one, two = grams(words.hashes(), window), grams(words.hashes(half=1), window)
                    k = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[place].view(np.int64)), pa.array(two[place].view(np.int64)), pa.nulls(k, pa.binary()), pa.array(ids[a:b][own].astype(np.int64)), pa.array(inner), pa.array(np.ones(k, np.int64))],
                        names=names,
                    )
                out = []
                for i in range(b - a):
                    if not (own_spans := spans[a + i].as_py()):
                        continue
                    lo, hi = int(words.first[i]), int(words.first[i + 1])
                    raw = words.data[words.start[lo] : words.end[hi - 1]].tobytes() if hi > lo else b""
                    _, text, starts = _joined(raw)
                    out += [(_digest(text, starts, x["at"], x["n"] + window - 1), ids[a + i], x["at"], x["n"]) for x in own_spans if x["at"] + x["n"] + window - 1 < len(starts)]
                if out:
                    digest, doc, at, n = zip(*out, strict=True)
                    none = pa.nulls(len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(digest, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=names)

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            raw = data.tobytes()
            total, removed, sha, texts = [], [], [], []
            for i in range(batch.num_rows):
                words, text, starts = _joined(raw[at[i] : at[i + 1]])
                total.append(len(words))
                if spans := batch.column(2)[i].as_py():
                    edge = np.zeros(len(words) + 1, np.int64)
                    for x in spans:
                        a, b = x["at"], x["at"] + x["n"] + window - 1
                        # spans of an unlike row with the same id may reach beyond this text
                        if b <= len(words) and (x["digest"] is None or x["digest"] == _digest(text, starts, a, b - a)):
                            edge[a] += 1
                            edge[b] -= 1
                    words = [words[j] for j in np.flatnonzero(edge[:-1].cumsum() == 0)]
                removed.append(total[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, seed: int = 8, with_text: bool = False) -> DataFrame:
    """Removes each word that lies in a window of ``window`` words whose word sequence also
    starts earlier: in a document of smaller id, or at an earlier word of the same one.

    Returns doc_id, n_words, n_removed and kept_sha256 for every row; ``with_text`` adds the
    kept words joined by one space.

    Null and empty texts have no words. Rows without an id can't be ordered: they neither
    lose words nor cost other rows any. Rows that repeat an id and a text are one document
    and all get its result; if their texts differ, coordinates are ambiguous: no words go but
    those that stand elsewhere too, and some of these may stay. Ties don't arise, coordinates
    being unique. Very long texts are handled whole, in memory in proportion to their
    length. An empty table gives an empty result. Other columns are ignored.
    """
    table = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = table.filter(F.col("doc_id").isNotNull())
    paths = known.mapInArrow(frugal(_paths(window, seed)), PATHS)
    repeated = written(paths.select("h").groupBy("h").count().filter("count > 1").select("h"), "repeated-minimizers")
    hits = written(paths.join(repeated, "h", "left_semi"), "repeated-paths")
    dropped(repeated)
    distinct = hits.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    distinct = written(distinct.select("h", "c", F.col("first.doc_id").alias("d0"), F.col("first.at").alias("a0"), "n", "times"), "distinct-paths")
    # A path's name is its first source coordinate, d0 and a0.
    found = hits.join(distinct.filter("times > 1").select("h", "c", "d0", "a0"), ["h", "c"]).select("d0", "a0", "n", "doc_id", "at")
    found = written(found, "path-occurrences")
    dropped(hits)
    spans = written(_merged(found), "merged-paths")
    # Where one minimizer has different paths, they may share some of their windows.
    forked = distinct.groupBy("h").count().filter("count > 1").select("h")
    apart = distinct.join(forked, "h", "left_semi").select(F.col("d0").alias("doc_id"), F.struct(F.col("a0").alias("at"), "n").alias("edge"), F.lit(None).cast("struct<at: long, n: long>").alias("span"))
    sources = spans.select(F.col("d0").alias("doc_id"), F.lit(None).cast("struct<at: long, n: int>").alias("edge"), F.struct(F.col("a0").alias("at"), "n").alias("span"))
    asked = apart.union(sources).groupBy("doc_id").agg(F.collect_list("edge").alias("edges"), F.collect_list("span").alias("spans"))  # nulls are left out
    read = known.join(asked, "doc_id").select("doc_id", "text", "edges", "spans")
    read = written(read.mapInArrow(frugal(_at_sources(window)), "w1 long, w2 long, digest binary, doc_id long, at long, n long"), "source-words")
    dropped(distinct, spans)
    edges = read.filter("w1 IS NOT NULL")
    shared = edges.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared.select("w1", "w2", F.col("f.doc_id").alias("d0"), F.col("f.at").alias("a0")), "shared-edges")
    single = edges.join(shared, ["w1", "w2"]).filter("doc_id != d0 or at != a0").select("doc_id", "at", "n", F.lit(None).cast("binary").alias("digest"))
    sources = read.filter("w1 IS NULL").select(F.col("doc_id").alias("d0"), F.col("at").alias("a0"), "n", "digest").distinct()
    whole = found.select("d0", "a0", "doc_id", "at").join(sources, ["d0", "a0"]).filter("doc_id != d0 or at != a0").select("doc_id", "at", "n", "digest")
    removed = whole.union(single).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "digest")).alias("spans"))
    out = RESULT + (", kept string" if with_text else "")
    nameless = table.filter(F.col("doc_id").isNull()).withColumn("spans", F.lit(None).cast("array<struct<at: long, n: long, digest: binary>>"))
    joined = known.join(removed, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.union(nameless).mapInArrow(frugal(_kept(window, with_text)), out)


def _merged(found: DataFrame) -> DataFrame:
    """Paths compacted over nonbranching nodes. found: every occurrence (doc_id, at) of every
    path that has more than one, the path being named by its first, (d0, a0), and of n
    windows. Returns d0, a0 and n of each merged path; its occurrences are those of the path
    that it begins with."""
    along = Window.partitionBy("doc_id").orderBy("at", "d0", "a0")
    # An occurrence goes on as at the source if the next path begins where this one ends, and
    # is the path that begins where this one ends at its source too.
    on = (F.lead("d0").over(along), F.lead("a0").over(along), F.lead("at").over(along))
    back = (F.lag("d0").over(along), F.lag(F.col("a0") + F.col("n")).over(along), F.lag(F.col("at") + F.col("n")).over(along))
    steps = found.select(
        "d0", "a0", "n",
        F.coalesce((on[0] == F.col("d0")) & (on[1] == F.col("a0") + F.col("n")) & (on[2] == F.col("at") + F.col("n")), F.lit(False)).alias("on"),
        F.coalesce((back[0] == F.col("d0")) & (back[1] == F.col("a0")) & (back[2] == F.col("at")), F.lit(False)).alias("back"),
    )
    # The nodes' degrees: one way in and one way out, if all occurrences agree.
    nodes = written(steps.groupBy("d0", "a0").agg(F.max("n").cast("long").alias("n"), F.min("on").alias("one_out"), F.min("back").alias("one_in")), "path-ends")
    # A path whose node is nonbranching joins the path before it.
    before = nodes.filter("one_out").select("d0", (F.col("a0") + F.col("n")).alias("a0"), F.lit(True).alias("joins"))
    joined = nodes.join(before, ["d0", "a0"], "left").select("d0", "a0", "n", F.coalesce(F.col("joins") & F.col("one_in"), F.lit(False)).alias("joins"))
    in_order = Window.partitionBy("d0").orderBy("a0")
    named = joined.withColumn("head", F.last(F.when(~F.col("joins"), F.col("a0")), ignorenulls=True).over(in_order))
    return named.groupBy("d0", F.col("head").alias("a0")).agg(F.sum("n").alias("n"))
