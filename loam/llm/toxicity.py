"""Toxic passages by maximum-scoring segment search.

A word's tokens are the word and its beginnings of a few lengths, which catch stems with
many endings. Hashed, they fall into ``BUCKETS`` buckets for each kind, whose log-odds
between toxic and clean labelled texts carry a Dirichlet prior in proportion to the
bucket's count in the whole corpus. The strongest token speaks for its word. Less a small
drift, these log-odds are the steps of a walk, and a linear-time scan finds all its
maximal segments. Scores of segments follow an
extreme-value law for clean texts; its rate comes from the steps, and its
scale from the best segments, of labelled clean texts. A logistic curve over the calibrated scores is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pick, written
from .words import Words, chunks, frugal

#: A power of 2.
BUCKETS = 1 << 17
#: Bytes of a word that a token has; None: all.
BEGINNINGS = (None, 4, 5, 6, 7, 8)
KINDS = len(BEGINNINGS)
#: Log-odds of fewer times their error count as 0.
CERTAIN = 4.0
#: Bins a unit of the histogram of steps.
FINE = 64
#: What each word costs a segment.
DRIFT = 0.05
#: Texts that the prior counts for: for each token, and in proportion to its share of the corpus.
PRIOR, PRIOR_SHARED = 1.0, 2_000.0
#: Expected number of equally good segments in a clean text up to which a segment is significant.
SIGNIFICANT = 0.05


@dataclass(frozen=True)
class Model:
    odds: np.ndarray  # by token
    rate: float
    scale: float
    curve: tuple[float, ...]


def segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a walk, as (start, end, score), in time linear in its
    length. Of each candidate the stack has the walk's height at both ends, and the place of
    the nearest candidate below that begins lower."""
    height = np.concatenate(([0.0], np.cumsum(steps)))
    stack: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(steps > 0).tolist():
        a, b, low, high = i, i + 1, height[i], height[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((a, b, low, high, j))
                break
            a, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in stack]


def best(steps: np.ndarray) -> float:
    """The score of the best segment, 0 if there is none."""
    if not len(steps):
        return 0.0
    height = np.cumsum(steps)
    lowest = np.minimum.accumulate(np.concatenate(([0.0], height[:-1])))
    return max(0.0, float((height - lowest).max()))


def tokens(words: Words) -> np.ndarray:
    """Places of each word's tokens among KINDS * BUCKETS, a row for each kind."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.stack([(words.hashes(lower=True, most=n) >> shift).astype(np.int64) + i * BUCKETS for i, n in enumerate(BEGINNINGS)])


def walk(odds: np.ndarray, words: Words) -> np.ndarray:
    """The step of each word: the log-odds of its strongest token, less the drift."""
    each = odds[tokens(words)]
    low, high = each.min(0, initial=0), each.max(0, initial=0)
    return np.where(high >= -low, high, low).astype(np.float64) - DRIFT


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a whole partition, counted at once."""
    n = np.zeros(KINDS * BUCKETS, np.int64)
    for batch in batches:
        for _, _, words in chunks(batch.column(0)):
            n += np.bincount(tokens(words).ravel(), minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n0"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each token, by fold and label: n0 to n3."""
    n = np.zeros((4, KINDS * BUCKETS), np.int64)
    for batch in batches:
        side = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, words in chunks(batch.column(0)):
            at, own = tokens(words), np.repeat(np.arange(b - a), np.diff(words.first))
            once = np.unique(at + own * n.shape[1])
            of = side[a:b][once // n.shape[1]]
            for i in range(4):
                n[i] += np.bincount(once[of == i] % n.shape[1], minlength=n.shape[1])
    some = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(x[some]) for x in n]], names=["bucket", "n0", "n1", "n2", "n3"])


def _totals(table: DataFrame) -> list[np.ndarray]:
    """Sums by bucket: at most KINDS * BUCKETS rows come to the driver."""
    columns = table.columns[1:]
    got = table.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = []
    for c in columns:
        x = np.zeros(KINDS * BUCKETS)
        x[got.column("bucket").to_numpy()] = got.column(c).to_numpy()
        out.append(x)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Log-odds ratios with a Dirichlet prior, 0 where they are near their error. 32 bits
    are enough, and a proven size: 4 * KINDS * BUCKETS bytes.

    toxic, clean: texts of each label that hold a token; texts: how many there are."""
    prior = PRIOR + PRIOR_SHARED * corpus / max(corpus.sum(), 1)
    share = texts[0] / sum(texts)
    t, c = toxic + share * prior, clean + (1 - share) * prior
    ratio = np.log(t / (texts[0] + share * prior)) - np.log(c / (texts[1] + (1 - share) * prior))
    z2 = ratio**2 / (1 / t + 1 / c)
    return np.where(z2 >= CERTAIN**2, ratio, 0).astype(np.float32)


def _steps(odds):
    """Histogram of the steps of clean texts, each by the odds of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False) // 2
            for a, b, words in chunks(batch.column(0)):
                own = np.repeat(fold[a:b], np.diff(words.first))
                for i in (0, 1):
                    bins, n = np.unique(np.round(walk(odds.value[i], words)[own == i] * FINE).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    return run


def _decay(steps: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(rate * step)] = 1."""
    p = weight / weight.sum()
    if not (steps[p > 0] > 0).any():
        return 1.0
    lo, hi = 0.0, 1e-3
    mean = lambda r: (p * np.exp(np.minimum(r * steps, 700))).sum()
    while mean(hi) < 1:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return max(hi, 1e-3)


FEATURES = 5


def _features(model: Model, steps: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Of a text: the surprise of its best segment, of all significant ones together, the
    evidence of all segments above one unit, as a sum and by word, and its length. With
    them the significant segments: start, end, -log(E)."""
    if not len(steps):
        return [0.0] * FEATURES, []
    size = float(np.log(len(steps)))
    offset = np.log(model.scale) + size
    found, total = [], 0.0
    if best(steps) * model.rate > 1:
        every = [(a, b, model.rate * x) for a, b, x in segments(steps) if model.rate * x > 1]
        found = [(a, b, x - offset) for a, b, x in every if x - offset >= -np.log(SIGNIFICANT)]
        total = sum(x for _, _, x in every)
    top = float(np.clip(model.rate * best(steps) - offset, -10, 60))
    return [top, float(np.log1p(sum(s for _, _, s in found))), float(np.log1p(total)), float(np.log1p(100 * total / len(steps))), size], found


SEEN = ["n", "best", *[f"x{i}" for i in range(FEATURES)]]
SEEN_TYPES = "side int, " + ", ".join(f"{c} double" for c in SEEN)


def _surprises(models):
    """Features of labelled texts, each by the model of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            fold = batch.column(1).to_numpy(zero_copy_only=False) // 2
            for at, _, words in chunks(batch.column(0)):
                steps = [walk(m.odds, words) for m in models.value]
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    f = fold[at + i]
                    out.append([b - a, best(steps[f][a:b]), *_features(models.value[f], steps[f][a:b])[0]])
            columns = np.array(out, float).reshape(-1, 2 + FEATURES).T
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns)], names=["side", *SEEN])

    return run


def _scores(model, carried: list[int]):
    """carried: columns that go before score and passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores, passages = [], []
            for _, _, words in chunks(batch.column(0)):
                steps = walk(m.odds, words)
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    x, found = _features(m, steps[a:b])
                    scores.append(float(_curve(m.curve, np.array([x]))[0]))
                    passages.append([{"first": x, "last": y - 1, "surprise": s} for x, y, s in found])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in carried], pa.array(scores, pa.float64()), pa.array(passages, pa.list_(PASSAGE))], names=[str(i) for i in range(len(carried) + 2)])

    return run


PASSAGE = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("surprise", pa.float64())])


def _curve(w: Sequence[float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a slight pull to 0."""
    if not len(y):
        return (-30.0, *[0.0] * FEATURES)
    if y.all() or not y.any():
        return (30.0 if y.all() else -30.0, *[0.0] * FEATURES)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    pull = np.array([1e-6, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return (float(w[0] - (w[1:] * mean / sd).sum()), *map(float, w[1:] / sd))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> Model:
    """Learns from at most ``max_rows`` labelled rows, those of the least hashes of their ids
    among the labels whose crc32(doc_id) mod 4 isn't 2; word frequencies are those of all
    documents. An id with several labels has the greatest, and equal texts count once.

    Two folds by the texts' hashes keep the curve honest: each is scored by the log-odds of
    the other. The model itself has those of both."""
    table = pick(docs, doc_id=doc_id, text=text)
    own = pick(labels, id=doc_id, toxic=label).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    own = own.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    own = own.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    train = table.join(F.broadcast(own), F.col("doc_id") == F.col("id"))
    train = train.groupBy("text").agg(F.max("toxic").alias("toxic"))
    train = written(train.select("text", (2 * F.pmod(F.xxhash64("text"), F.lit(2)) + F.col("toxic")).cast("int").alias("side")), "labelled")
    sc = docs.sparkSession.sparkContext
    (corpus,) = _totals(table.select("text").mapInArrow(frugal(_corpus), "bucket int, n0 long"))
    held = _totals(train.mapInArrow(frugal(_labelled), "bucket int, n0 long, n1 long, n2 long, n3 long"))
    rows = {r["side"]: r["count"] for r in train.groupBy("side").count().collect()}
    texts = [rows.get(i, 0) for i in range(4)]

    def odds(*folds: int) -> np.ndarray:
        clean, toxic = (sum(texts[2 * f + i] for f in folds) for i in (0, 1))
        if not (clean and toxic):
            return np.zeros(KINDS * BUCKETS, np.float32)
        return log_odds(sum(held[2 * f + 1] for f in folds), sum(held[2 * f] for f in folds), corpus, (toxic, clean))

    crossed = [odds(1), odds(0)]
    shape = train.filter("side % 2 = 0").mapInArrow(frugal(_steps(sc.broadcast(crossed))), "bin int, n long")
    shape = shape.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    rate = _decay(shape.column("bin").to_numpy() / FINE, shape.column("n").to_numpy()) if len(shape) else 1.0

    def seen(scale: float) -> DataFrame:
        return train.mapInArrow(frugal(_surprises(sc.broadcast([Model(o, rate, scale, ()) for o in crossed]))), SEEN_TYPES)

    row = seen(1.0).filter("side % 2 = 0 AND n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.exp(-rate * F.col("best"))).alias("s")).first()
    scale = max(row["k"], 1) / max(row["s"] or 1.0, 1e-12)
    got = seen(scale).orderBy("side", *SEEN).limit(max_rows).toArrow()
    x = np.column_stack([got.column(c).to_numpy() for c in SEEN[2:]])
    return Model(odds(0, 1), rate, scale, _fit_curve(x, got.column("side").to_numpy() % 2.0))


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, max_rows: int = 20_000, carry: Sequence[str] = ()
) -> DataFrame:
    """Scores every text from 0 to 1; higher: label 1 likelier. Returns doc_id, the columns
    named in ``carry``, held_out (crc32(doc_id) mod 4 is 2; such labels aren't learnt), score,
    predicted (1 from ``threshold`` on) and passages: first and last word of each significant
    toxic passage, from 0, and its calibrated surprise.

    ``max_rows`` bounds the labelled rows that the model is fitted on, and so what is
    broadcast of them; the word log-odds have a fixed number of buckets. Labels, languages,
    sources and ids are no inputs of a score.

    Null and empty texts are scored as texts without words. Rows without an id are scored
    and not held out; repeated rows are each scored. Null labels aren't learnt; without
    labels of both kinds every score is near the label there is, or near 0. Very long texts
    are scanned whole. An empty table gives an empty result. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, max_rows))
    named = {f"c{i}": c for i, c in enumerate(carry) if c != text}  # the text goes to Python once
    table = pick(docs, text=text, doc_id=doc_id, **named)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    table = table.select("text", "doc_id", *named, held.alias("held_out"))
    of = {c: a for a, c in named.items()} | {text: "text"}
    out = [("doc_id", "doc_id"), *[(of[c], c) for c in carry], ("held_out", "held_out")]
    fields = [T.StructField(c, table.schema[a].dataType) for a, c in out]
    passage = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("surprise", T.DoubleType())])
    fields += [T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))]
    scored = table.mapInArrow(frugal(_scores(model, [table.columns.index(a) for a, _ in out])), T.StructType(fields))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
