"""Near-duplicate documents by b-bit MinHash.

Every shingle set gets ``bands * rows`` minima of 32-bit hashes. Bands of whole minima
make candidates; of every minimum only the low two bits are kept besides, packed in
64-bit words, and the similarity of two candidates is estimated from the bit counts of
these words, corrected for fields that agree by chance. Pairs that may reach the
threshold are confirmed on full shingle sets.

Copies never make pairs: equal sets are one class with one representative. In a bucket
each representative is first held against the least one only. What these links leave in
different components is then compared inside tasks, in pairs of blocks of bounded size that
carry signatures; those rows that have a likely partner in a block pair meet there again
with their full sets. No link is lost, no pairs are sent anywhere, and a bucket whose
members are one component, however large, costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, pick, written
from .words import Words, chunks, frugal, grams, mix

BITS = 2
CHUNK = 1 << 19
EVERY_OTHER = 0x5555555555555555


def shingle_sets(words: Words, k: int, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other; how many each has; and,
    if ``twice``, independent second hashes of the same shingles. A text of fewer than k words
    has its whole word sequence as its only shingle."""
    n = np.diff(words.first)
    own = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(own[: max(len(own) - k + 1, 0)] == own[k - 1 :]) if len(own) >= k else np.zeros(0, np.int64)
    short = [np.flatnonzero(n == m) for m in range(1, k)]
    doc = np.concatenate([own[inside], *short])

    def values(half: int) -> np.ndarray:
        h = words.hashes(lower=True, half=half)
        parts = [mix(grams(h, m, 1000 + m)[words.first[x]]) for m, x in enumerate(short, 1) if len(x)]
        return np.concatenate([grams(h, k)[inside], *parts])

    value = values(0)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(n)), values(1)[order][new] if twice else value[:0]


def _sign(k: int, bands: int, rows: int):
    total = bands * rows
    rng = np.random.default_rng(271828)
    times = rng.integers(0, 2**32, total, dtype=np.uint32) | np.uint32(1)
    plus = rng.integers(0, 2**32, total, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in chunks(batch.column(1), CHUNK):
                values, sizes, others = shingle_sets(words, k, twice=True)
                full = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                digest = np.zeros((2, b - a), np.uint64)
                least = np.zeros((b - a, total), np.uint32)
                if len(full):
                    with np.errstate(over="ignore"):
                        digest[0, full] = np.add.reduceat(mix(values + np.uint64(1)), at)
                        digest[1, full] = np.add.reduceat(mix(others + np.uint64(1)), at)
                        x = (values >> np.uint64(32)).astype(np.uint32)
                        for i in range(total):
                            least[full, i] = np.minimum.reduceat(x * times[i] + plus[i], at)
                        key = np.zeros((b - a, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                        for i in range(rows):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, i::rows])
                low = ((least[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).reshape(b - a, -1)
                low = np.packbits(np.pad(low, ((0, 0), (0, -low.shape[1] % 64))), axis=1, bitorder="little").view(np.int64)
                key = key if len(full) else np.zeros((b - a, bands), np.uint64)
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()) for x in (low, key.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), *lists],
                    names=["doc_id", "n", "d1", "d2", "low", "keys"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1), CHUNK):
                values, sizes, _ = shingle_sets(words, k)
                raw, ends = values.tobytes(), np.cumsum(sizes) * 8
                shingles = [raw[e - 8 * s : e] for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shingles, pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return run


def _likely(part: list, r: int, percent: int, total: int, floor: float, crossed: bool) -> np.ndarray:
    """Later rows of a block pair that row r may be linked to, and that are of another
    component: sizes allow it, and so does the estimate of their signatures."""
    _, n, group, block, low = part[:5]
    ok = (group[r + 1 :] != group[r]) & (100 * np.minimum(n[r], n[r + 1 :]) >= percent * np.maximum(n[r], n[r + 1 :]))
    if crossed:
        ok &= block[r + 1 :] != block[r]
    other = np.flatnonzero(ok) + r + 1
    if not len(other):
        return other
    x = low[other] ^ low[r]
    unlike = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(EVERY_OTHER)).sum(1)
    chance = 0.5**BITS
    return other[((1 - unlike / total) - chance) / (1 - chance) >= floor]


def _by_block(batches: Iterator[pa.RecordBatch], sets: bool) -> Iterator[tuple[tuple, list]]:
    """The rows of each block pair, (key, i, j) and doc, n, component, block, low and, if there
    are, sets. No more than one pair's rows are held."""
    held: list = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j, doc, n, comp, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        low = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(key), -1)
        columns = [doc, n, comp, block, low]
        if sets:
            columns.append(np.fromiter((np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(8)), object, len(key)))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *ends], [*ends, len(key)], strict=True):
            own = (key[a], i[a], j[a])
            if own != mark:
                if held:
                    yield mark, [np.concatenate(x) for x in zip(*held, strict=True)]
                held, mark = [], own
            held.append([x[a:b] for x in columns])
    if held:
        yield mark, [np.concatenate(x) for x in zip(*held, strict=True)]


BLOCKS = "key long, i int, j int, doc_id long, n long, component long, block int, low array<long>"


def _hopeful(percent: int, total: int, floor: float):
    """The rows of each block pair that have a likely partner in it: only these need their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), part in _by_block(batches, False):
            crossed = len(np.unique(part[3])) > 1
            some = np.zeros(len(part[0]), bool)
            for r in range(len(some) - 1):
                other = _likely(part, r, percent, total, floor, crossed)
                some[other] = True
                some[r] |= len(other) > 0
            k = int(some.sum())
            if k:
                doc, n, comp, block, low = (x[some] for x in part)
                lows = pa.ListArray.from_arrays(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32), low.view(np.int64).ravel())
                fixed = [pa.array(np.full(k, x, t)) for x, t in ((key, np.int64), (i, np.int32), (j, np.int32))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(doc), pa.array(n), pa.array(comp), pa.array(block), lows], names=["key", "i", "j", "doc_id", "n", "component", "block", "low"])

    return run


def _across(percent: int, total: int, floor: float):
    """Links within each block pair that join different components, confirmed on full sets;
    of links that join the same components, one."""

    def linked(part: list) -> list[tuple[int, int]]:
        doc, n, comp, block, low, sets = part
        _, group = np.unique(comp, return_inverse=True)
        crossed = len(np.unique(block)) > 1
        out = []
        for r in range(len(doc) - 1):
            other = _likely([doc, n, group, block, low], r, percent, total, floor, crossed)
            if not len(other):
                continue
            own, theirs = sets[r], np.concatenate([sets[k] for k in other])
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(hit, np.cumsum(n[other]) - n[other], dtype=np.int64)
            for k in other[100 * both >= percent * (n[r] + n[other] - both)]:
                if group[k] != group[r]:
                    group[group == group[k]] = group[r]
                    out.append((doc[r], doc[k]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_block(batches, True):
            if out := linked(part):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    return run


def _like(total: int, words: int):
    """The estimated similarity of two packed signatures, corrected for chance agreement."""
    chance = 0.5**BITS
    unlike = sum(F.bit_count((x := F.col("low_u")[i].bitwiseXOR(F.col("low_v")[i])).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(EVERY_OTHER))) for i in range(words))
    return (1 - unlike / total - chance) / (1 - chance)


def minhash_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80, bands: int = 48, rows: int = 6, floor: float = 0.6, block: int = 1024, shingles: int = 1 << 20
) -> DataFrame:
    """Links documents whose sets of ``shingle``-word sequences, A to Z in lower case, have
    a Jaccard similarity of ``percent`` % or more. Returns for every row doc_id, n_shingles,
    component_id (the least id that links reach, or its own) and kept: whether it is that.

    With 48 bands of 6 rows, one pair in a million at exactly 80 % is in no bucket; the
    estimate's ``floor`` of 0.6 lies six standard deviations below 80 %. ``block`` rows, and
    ``shingles`` of their sets, bound what a task compares with as much at once, on average.

    Fewer words than ``shingle`` are one shingle; null and empty texts and texts of blanks
    have none and are linked with nothing. Rows without an id are kept and have no
    component. Rows that repeat an id are one document. Equal texts are always linked.
    Very long texts are handled whole. An empty table gives an empty result. Other columns
    are ignored.
    """
    total = bands * rows
    long_words = -(-total * BITS // 64)
    table = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = written(table.mapInArrow(frugal(_sign(shingle, bands, rows)), "doc_id long, n long, d1 long, d2 long, low array<long>, keys array<long>"), "signatures")
    named = signed.filter("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(named.join(classes, ["d1", "d2", "n"]).filter("doc_id = rep").select("doc_id", "n", "low", "keys"), "representatives")
    dealt = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("held")).filter("size > 1")
    buckets = written(buckets, "buckets")
    members = written(dealt.join(buckets, "key").select("key", "doc_id", "n", "least", "size", "held"), "members")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs u, v with sizes that allow the threshold and a sufficient estimate."""
        side = reps.select("doc_id", "n", "low")
        out = pairs.join(side.toDF("u", "n_u", "low_u"), "u").join(side.toDF("v", "n_v", "low_v"), "v")
        out = out.filter(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        return out.filter(_like(total, long_words) >= floor).select("u", "v")

    def full(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "wanted-ids")  # narrow, so Spark knows its size before it joins
        sets = table.join(ids, "doc_id").select("doc_id", "text").mapInArrow(frugal(_sets(shingle)), "doc_id long, shingles binary")
        return written(sets, "shingle-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        sets = full(pairs.select(F.inline(F.array(F.struct(F.col("u").alias("doc_id")), F.struct(F.col("v").alias("doc_id"))))))
        held = pairs.join(sets.toDF("u", "s_u"), "u").join(sets.toDF("v", "s_v"), "v")
        links = written(held.select("u", "v", "s_u", "s_v").mapInArrow(frugal(_confirm(percent)), "u long, v long"), "links")
        dropped(pairs, sets)
        return links

    def joined(links: DataFrame) -> DataFrame:
        return written(components(links).withColumnRenamed("node", "doc_id"), "components")

    # One link each to the least document of all buckets joins most of a large group; the
    # least members of single buckets matter only where they are of another component still.
    stars = members.filter("doc_id != least").groupBy("doc_id").agg(F.min("least").alias("u"))
    links = confirmed(allowed(stars.select("u", F.col("doc_id").alias("v"))))
    found = joined(links)
    tips = members.filter("doc_id != least").join(found, "doc_id", "left").withColumn("c_v", F.coalesce("component", "doc_id")).drop("component")
    tips = tips.join(found.toDF("least", "component"), "least", "left").filter(F.coalesce("component", "least") != F.col("c_v"))
    more = written(tips.select(F.col("least").alias("u"), F.col("doc_id").alias("v")).distinct(), "star-pairs")
    if not more.isEmpty():
        links = links.union(confirmed(allowed(more)))
        found = joined(links)
    # What is left: pairs of a bucket in different components, neither of them the least member.
    rest = members.filter("doc_id != least AND size > 2").join(found, "doc_id", "left")
    rest = rest.select("key", "doc_id", "n", "size", "held", F.coalesce("component", "doc_id").alias("component"))
    rest = written(rest, "bucket-components")
    mixed = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key")
    rest = written(rest.join(mixed, "key", "left_semi"), "mixed-buckets")
    # Blocks of at most so many rows, and shingles, on average. Signatures go through all
    # pairs of blocks; sets only where a signature has found a likely partner.
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("held") / shingles)).cast("int")
    rest = rest.join(reps.select("doc_id", "low"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "n", "component", "block", "low")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = written(rest.mapInArrow(frugal(_hopeful(percent, total, floor)), BLOCKS), "hopeful-blocks")
    rest = rest.join(full(rest.select("doc_id")), "doc_id").select("key", "i", "j", "doc_id", "n", "component", "block", "low", "shingles")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = written(rest.mapInArrow(frugal(_across(percent, total, floor)), "u long, v long").distinct(), "cross-links")
    if not more.isEmpty():
        found = joined(links.union(more))
    verdicts = classes.join(found.withColumnRenamed("doc_id", "node"), F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    verdicts = written(verdicts, "class-components")
    out = signed.select("doc_id", "n", "d1", "d2").join(verdicts, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
