"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which for
UTF-8 is the same as a run of such code points. Hashing runs over whole column
buffers, without a Python object for each word.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one, by BLAKE2.
LONG = 64
#: Words hashed at once, which stay in the processor's cache.
SLICE = 1 << 15
#: Start, multiplier and length's multiplier of each of the two independent hashes of a word.
_START = np.array([0x243F6A8885A308D3, 0xA4093822299F31D0], np.uint64)
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SIZED = np.array([0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    with np.errstate(over="ignore"):
        shifted = h >> np.uint64(32)
        h = h ^ shifted
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= np.right_shift(h, np.uint64(29), out=shifted)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= np.right_shift(h, np.uint64(32), out=shifted)
        return h


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands back the memory that it holds but no longer uses:
    workers live on, and an executor has one for each core."""

    def frugal_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return frugal_run


@dataclass
class Words:
    """start, end: byte places in data. first[i]:first[i + 1]: the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False, most: int | None = None, half: int = 0) -> np.ndarray:
        """One 64-bit hash for each word, or for its first ``most`` bytes. A word's hashes of
        half 0 and half 1 are independent of each other, and not linear in its bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        data = _LOWER[self.data] if lower else self.data
        eight = _eights(data)
        out = np.empty(len(self.start), np.uint64)
        for at in range(0, len(out), SLICE):
            start, size = self.start[at : at + SLICE], end[at : at + SLICE] - self.start[at : at + SLICE]
            h = _step(_START[half], eight[start] & _FIRST[np.minimum(size, 8)], np.where(size <= 8, size, 0), half)
            live, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
            while len(live):
                left = size[live] - done
                last = left <= 8
                h[live] = _step(h[live], eight[start[live] + done] & _FIRST[np.minimum(left, 8)], np.where(last, size[live], 0), half)
                live = live[~last]
                done += 8
            for i in np.flatnonzero(size > LONG).tolist():
                digest = hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=16).digest()
                h[i] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
            out[at : at + SLICE] = h
        return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; 0 beyond the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", held, strides=(1,))


def _step(h: np.ndarray | np.uint64, eight: np.ndarray, size: np.ndarray | int, half: int) -> np.ndarray:
    """h after eight more bytes; size: the whole word's where these are its last, else 0."""
    with np.errstate(over="ignore"):
        x = eight + h * _TIMES[half]
        x += np.asarray(size).astype(np.uint64) * _SIZED[half]
        return mix(x)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def split(data: np.ndarray, at: np.ndarray) -> Words:
    word = ~_SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def chunks(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, Words]]:
    """Rows a:b of a text column and their words, about ``size`` bytes at a time."""
    data, at = buffers(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b, split(data[at[a] : at[b]], at[a : b + 1] - at[a])
        a = b


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k hashes in a row; entry i covers i to i + k - 1, across texts too. Built by
    doubling, with a mix at each step, so they aren't linear in the hashes either."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    if len(h) < k:
        return np.zeros(0, np.uint64)

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(x * np.uint64(0x9DDFEA08EB382D6B) + y)

    def run(h: np.ndarray) -> np.ndarray:
        out, size = None, 0  # what covers the first ``size`` of each run
        part, width = mix(h ^ mix(np.array([salt + 1], np.uint64))), 1
        while True:
            if k & width:
                out = part if out is None else both(out[: len(part) - size], part[size:])
                size += width
            width *= 2
            if width > k:
                return out[: len(h) - k + 1]
            part = both(part[: -(width // 2)], part[width // 2 :])

    return np.concatenate([run(h[a : a + SLICE + k - 1]) for a in range(0, len(h) - k + 1, SLICE)])


class Substrings:
    """Hashes of substrings, equal to those of words."""

    def __init__(self, data: np.ndarray):
        self.data, self.eight = data, _eights(data)
        self.after = [np.full(len(data) + 1, _START[0])]  # after i whole eights from each place

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        if size > LONG:
            return Words(self.data, start, start + size, np.array([0, len(start)])).hashes()
        done = max(size - 1, 0) // 8
        while len(self.after) <= done:
            h = self.after[-1]
            n = max(len(h) - 8, 0)
            self.after.append(_step(h[:n], self.eight[8 * len(self.after) - 8 :][:n], 0, 0))
        return _step(self.after[done][start], self.eight[start + 8 * done] & _FIRST[size - 8 * done], size, 0)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return out + np.arange(total)
