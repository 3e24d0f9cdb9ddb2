"""Sampled segmentations of texts into the pieces of a SentencePiece vocabulary, and back.

Forward filtering sums the weight of all ways to reach each place of the piece lattice;
backward sampling then walks from the end, choosing each piece with its share of that
sum. No piece crosses from a non-blank to a space, so the lattice falls apart into chunks
(spaces and what follows them), and equal chunks of a batch share one forward pass, in which
they fall apart again wherever no piece crosses. All
chunks of a batch go through both passes together, as arrays. Every choice is drawn from
a hash of the row's key and the place in the text: reruns, other partitions and lost
executors change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pick
from .words import Substrings, Words, buffers, frugal, mix, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 32
BATCH = 2 << 20
BLOCK = 1 << 17


@dataclass(frozen=True)
class Pieces:
    """text[start[i]:start[i + 1]]: the bytes of piece i, a space for each meta symbol.
    first, second: places of pieces in two hash tables; byte: the pieces of single bytes."""

    text: np.ndarray
    start: np.ndarray
    weight: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    second: np.ndarray
    byte: np.ndarray
    longest: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, -1 where there is none."""
        a, b = self.first[h >> np.uint64(44)], self.second[(h >> np.uint64(16)) & np.uint64(0xFFFFF)]
        return np.where(self.hashes[a] == h, a, np.where(self.hashes[b] == h, b, -1))


def load(path: str = MODEL, sharpness: float = 0.5) -> Pieces:
    """The pieces of a SentencePiece model file with byte fallback. A piece weighs the
    ``sharpness``-th power of its Zipf share: one over its rank in the order of scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw, byte, plain = [], np.full(256, -1, np.int64), []
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(model.id_to_piece(i).replace("▁", " ").encode())
            plain.append(i)
    if (byte < 0).any():
        raise ValueError("the model has no byte fallback, so decoding would lose text")
    if any(b" " in x.lstrip(b" ") for i in plain if (x := raw[i])):
        raise ValueError("a piece of the model crosses from a non-blank to a space")
    text = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    rank = np.empty(n)
    rank[sorted(range(n), key=lambda i: (-model.get_score(i), i))] = np.arange(n)
    # special pieces aside, lower scores come later, and bytes last of all
    share = 1 / (rank + 2)
    plain = np.array(plain)
    share /= share[plain].sum()
    share[byte] = share[plain].min()
    weight = sharpness * np.log(share)
    every = Words(text, start[:-1], start[1:], np.array([0, n])).hashes()
    hashes = np.zeros(n, np.uint64)
    hashes[plain] = every[plain]
    first, second = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
    for i in plain:
        a, b = int(hashes[i]) >> 44, int(hashes[i]) >> 16 & 0xFFFFF
        if not first[a]:
            first[a] = i
        elif not second[b]:
            second[b] = i
        else:
            raise ValueError("the vocabulary is too large for its hash tables")
    return Pieces(text, start, weight, hashes, first, second, byte, int(np.diff(start)[plain].max()))


def _edges(p: Pieces, data: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lattice of chunks that fill data: from, to and piece of each edge. until: where the
    chunk of each byte ends."""
    n = len(data)
    lead = np.append((data & 0xC0) != 0x80, True)
    at = np.flatnonzero(lead[:-1])
    wide = np.zeros(n, np.int64)
    wide[at] = np.diff(np.append(at, n))
    known = np.zeros(n, bool)
    parts = Substrings(data)
    fro, to, piece = [], [], []
    for size in range(1, p.longest + 1):
        at = at[at + size <= until[at]]
        if not len(at):
            break
        whole = at[lead[at + size]]  # pieces are whole characters
        found = p.find(parts.hashes(whole, size))
        ok = np.flatnonzero(found >= 0)
        whole = whole[ok]
        fro.append(whole.astype(np.int32))
        to.append((whole + size).astype(np.int32))
        piece.append(found[ok])
        if size <= 4:
            known[whole[wide[whole] == size]] = True
    alone = np.flatnonzero(lead[:-1] & ~known)
    alone = ranges(alone, wide[alone]).astype(np.int32)
    return np.concatenate([*fro, alone]), np.concatenate([*to, alone + 1]), np.concatenate([*piece, p.byte[data[alone]].astype(np.int32)])


def filtered(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward filtering of chunks that fill data. Returns the edges' lengths and pieces,
    sorted by where they end; for each, the share of the edges up to it among those that end
    there; the first edge that ends at each place; and the places that no edge crosses."""
    parts, firsts, cuts, a, edges = [], [], [], 0, 0
    while a < len(start):  # some chunks at a time, which stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, "right")))
        x, y = start[a], end[b - 1]
        *part, first, cut = _filter(p, data[x:y], start[a:b] - x, end[a:b] - x)
        parts.append(part)
        firsts.append(first + edges)
        cuts.append(cut + x)
        edges += len(part[0])
        a = b
    first = np.concatenate([[0], *firsts]).astype(np.int32)
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), first, np.concatenate(cuts)


def _filter(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    fro, to, piece = _edges(p, data, np.repeat(end, end - start))
    order = np.argsort(to, kind="stable")
    fro, to, piece = fro[order], to[order], piece[order]
    # All ways pass a place that no edge crosses, so the lattice falls apart there as well,
    # and text without spaces doesn't make long chunks.
    n = len(data) + 2
    cut = np.cumsum(np.bincount(fro + 1, minlength=n) - np.bincount(to, minlength=n))[: len(data)] == 0
    cut[start] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    base = np.repeat(start, end - start)
    level = to - base[to - 1]
    if len(level) and level.max() < 1 << 16:
        level = level.astype(np.uint16)  # sorted by radix
    order = np.argsort(level, kind="stable")
    # height[q + chunk]: log weight of all ways from the chunk's start to place q; a chunk has one place more than bytes
    chunk = np.repeat(np.arange(len(start)), end - start)
    lo, hi = fro + chunk[fro], to + chunk[to - 1]
    height = np.full(len(data) + len(start), -np.inf)
    height[start + np.arange(len(start))] = 0
    cuts = np.searchsorted(level[order], np.arange(1, int(level.max()) + 2)) if len(level) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        if len(own):
            ends = hi[own]
            heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            height[ends[heads]] = np.logaddexp.reduceat(height[lo[own]] + p.weight[piece[own]], heads)
    share = np.exp(height[lo] + p.weight[piece] - height[hi])
    share[~np.isfinite(share)] = 0  # no way leads there
    heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    total = np.cumsum(share)
    before = np.repeat(np.append(0, total)[heads], np.diff(np.append(heads, len(to))))
    upto = np.minimum(total - before, 1)
    last = np.append(heads[1:], len(to)) - 1
    # rounding must not let the last possible edge miss 1
    upto[last] = 1
    first = np.zeros(len(data), np.int32)
    first[to[heads] - 1] = heads
    return to - fro, piece, upto.astype(np.float32), first, start


def sample(p: Pieces, data: np.ndarray, at: np.ndarray, keys: np.ndarray, share: bool = True) -> np.ndarray:
    """Piece of each byte of data that a sampled piece ends with, -1 elsewhere. Texts are
    data[at[i]:at[i + 1]]; keys: a 64-bit hash for each."""
    n = len(data)
    out = np.full(n, -1, np.int32)
    if not n:
        return out
    space = data == SPACE
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    text = np.searchsorted(at, start, "right") - 1
    if share:
        _, which, of = np.unique(Words(data, start, end, np.array([0, len(start)])).hashes(), return_index=True, return_inverse=True)
    else:
        which = of = np.arange(len(start))
    size = (end - start)[which]
    inner_end = np.cumsum(size)
    lengths, pieces, upto, first, cuts = filtered(p, data[ranges(start[which], size)], inner_end - size, inner_end)
    # every stretch between such places has a walk of its own, from its end
    at_cut = np.searchsorted(cuts, inner_end - size)
    n_cuts = np.searchsorted(cuts, inner_end) - at_cut
    walk = ranges(at_cut[of], n_cuts[of])
    live, left, stop = np.arange(len(walk)), np.append(cuts[1:], inner_end[-1])[walk], cuts[walk]
    shift, text = np.repeat(end - inner_end[of], n_cuts[of]), np.repeat(text, n_cuts[of])
    origin = at[text]
    with np.errstate(over="ignore"):
        while len(live):
            place = (left + shift)[live]
            u = mix(keys[text[live]] + (place - origin[live]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = ((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            edge = first[left[live]]
            short = np.flatnonzero(upto[edge] < u)
            while len(short):
                edge[short] += 1
                short = short[upto[edge[short]] < u[short]]
            out[place - 1] = pieces[edge]
            left[live] -= lengths[edge]
            live = live[left[live] > stop[live]]
    return out


def decode(p: Pieces, ids: np.ndarray) -> bytes:
    """The text of pieces, with the space that encoding puts before it."""
    return p.text[ranges(p.start[ids], np.diff(p.start)[ids])].tobytes()


def _prefixed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, with a space before each that isn't empty."""
    data, at = buffers(column)
    full = np.diff(at) > 0
    return np.insert(data, at[:-1][full], SPACE), at + np.concatenate(([0], np.cumsum(full)))


def _encode(pieces, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            data, at = _prefixed(batch.column(0))
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            a, n = 0, batch.num_rows
            while a < n:
                b = max(a + 1, int(np.searchsorted(at, at[a] + BATCH, "right")) - 1)
                part, cuts = data[at[a] : at[b]], at[a : b + 1] - at[a]
                with np.errstate(over="ignore"):
                    own = mix(keys[a:b] + np.uint64(seed))
                got = sample(p, part, cuts, own)
                ends = np.flatnonzero(got >= 0)
                ids = got[ends]
                if decode(p, ids) != part.tobytes():  # chunks taken for equal by their hashes
                    got = sample(p, part, cuts, own, share=False)
                    ends = np.flatnonzero(got >= 0)
                    ids = got[ends]
                split = np.searchsorted(ends, cuts)
                counts = np.diff(split)
                raw = ids.astype("<i4")
                text = [decode(p, ids[x:y])[1:] for x, y in zip(split[:-1], split[1:], strict=True)]
                columns = [
                    *[c.slice(a, b - a) for c in batch.columns[2:]],
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(split[:-1], split[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in text], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(split.astype(np.int32), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
                a = b

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, sharpness: float = 0.5, seed: int = 0, with_ids: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Samples a segmentation of every text. Returns doc_id, the columns named in ``carry``,
    n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), text_sha256 (of the
    text that they decode to, equal to that of the input) and, ``with_ids``, the ids.

    As in the library, one space goes before a text that isn't empty, and decoding takes it
    off; characters without a piece become byte pieces, and so do meta symbols that the
    text itself holds. ``model`` is a file of the driver's; the vocabulary is broadcast, a
    few megabytes whatever the input.

    Null and empty texts have no pieces. Rows without an id are seeded alike, and so are
    rows that repeat an id, whose equal texts then get equal pieces. Very long texts and
    words are segmented whole. An empty table gives an empty result. Other columns are
    ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model, sharpness))
    named = {f"c{i}": c for i, c in enumerate(carry)}
    table = pick(docs, text=text, doc_id=doc_id, **named)
    table = table.select("text", F.xxhash64("doc_id").alias("key"), "doc_id", *named)
    fields = [T.StructField(c, table.schema[a].dataType) for a, c in (("doc_id", "doc_id"), *named.items())]
    fields += [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("text_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return table.mapInArrow(frugal(_encode(pieces, seed, with_ids)), T.StructType(fields))


def decoded(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds text: what the ids decode to; null ids give a null text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load(model))
    schema = T.StructType([*[x for x in encoded.schema.fields if x.name != "text"], T.StructField("text", T.StringType())])
    names = [x.name for x in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else decode(pieces.value, x.values.to_numpy(zero_copy_only=False))[1:].decode() for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(frugal(run), schema)
