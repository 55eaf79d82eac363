"""Numpy views of Arrow text batches: words, word hashes and k-gram hashes.

Everything here runs inside Spark tasks on one block of whole documents at a time.
A block holds documents of about ``BLOCK_BYTES`` together; one longer document is a
block of its own, so temporary arrays follow the longest document, never the partition.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: `[^\x20\x09-\x0D]+` on UTF-8 bytes: every byte of a longer code point is over 0x7F.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: What empties the large tables a worker keeps from task to task.
emptied: list[Callable[[], None]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(max(n, BLOCK_BYTES + 1), base, _U)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]: equal spans have equal hashes wherever they stand."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k values; grams across documents are for the caller to drop."""
    if len(values) < k:
        return np.zeros(0, _U)
    at = np.arange(len(values) - k + 1)
    return span_hashes(values, at, at + k)


def let_go() -> None:
    """Empty the large tables of this worker."""
    for empty in emptied:
        empty()


def hand_back() -> None:
    """Give memory that is free but held by the allocators back to the machine, with the powers of very long texts."""
    if len(_powers[0]) > BLOCK_BYTES + 1:
        _powers[:] = [np.ones(1, _U), np.ones(1, _U)]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable | None = None, *, keeps: bool = False) -> Callable:
    """A function over batches that hands its free memory back when a task ends: Spark keeps its workers.

    keeps: it uses the large tables of its worker; any other function empties them first.
    What is wrapped is sent to the workers by value, so it calls functions of this module alone.
    """
    if run is None:
        return functools.partial(tidy, keeps=keeps)

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


class Block:
    """Whole documents lo..hi of a batch: `data` bytes and the documents' `bounds` in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int):
        self.data, self.bounds, self.lo, self.n = data, bounds, lo, len(bounds) - 1

    def words(self, table: np.ndarray, lower: bool = False) -> "Words":
        data = LOWER[self.data] if lower else self.data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.bounds] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        return Words(data, starts, ends, np.searchsorted(starts, self.bounds))


class Words:
    """Words of a block: byte spans; words first[d]..first[d + 1] are those of document d."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def inside(self, k: int) -> np.ndarray:
        """For every gram of k words of the block: is it within one document?"""
        n = max(len(self.starts) - k + 1, 0)
        return np.repeat(self.first[1:], self.counts())[:n] >= np.arange(n) + k


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column, without a copy; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's documents in blocks of about `limit` bytes."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 20_000, n)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def per_doc_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[d]:bounds[d + 1]] for every d; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as sorted, disjoint, non-touching intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
