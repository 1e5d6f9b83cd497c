"""Texts of an Arrow batch as byte arrays, cut into blocks of bounded size, and hashes of spans in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of numpy work covers. A longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Odd base of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows that hold about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.binary()).cast(pa.large_binary())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the next block."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1024), np.uint64)
        done = 1
        while done < len(known):
            step = min(done, len(known) - done)
            known[done : done + step] = known[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = known
    return known[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of one byte array, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray) -> None:
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=self.prefix[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    """Space and the control characters 9 to 13."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a document's edge."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first word of each document (one entry more than documents)."""
    starts, ends = runs(~is_space(data), offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(total)


def whole_windows(first: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` words, whether it lies in one document; ``first`` as words() gives it."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[: total - n + 1] >= n


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of spans, one span after the other."""
    total = int(lengths.sum())
    shift = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=shift[1:]) if len(lengths) else None
    return np.repeat(starts - shift, lengths) + np.arange(total)


def sums_before(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, … values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, empty slices included."""
    total = sums_before(values)
    return total[bounds[1:]] - total[bounds[:-1]]
