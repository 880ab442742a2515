"""Words and word windows of many texts at once, as arrays.

A word is a run of bytes other than blank and 0x09-0x0D.  Words and windows of words are
known by 64-bit hashes; the numbers of characters and places behind them are fixed, so
that every task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pretokens import mixed

_BYTES = mixed(np.arange(256) + (7 << 40))
_FACTORS = mixed(np.arange(1 << 12) + (9 << 40)) | np.uint64(1)
HASHED_BYTES = 1 << 20  # hashed at a time
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Words:
    """Words of texts laid end to end: place, length, hash, and for each text its first word."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more entry than texts

    @property
    def text(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words within a text, and each window's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * _powers_of(_BASE, n), out=sums[1:])
        values = mixed((sums[k:] - sums[:-k]) * _powers_of(_INVERSE, n - k + 1))
        text = self.text
        inside = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        return values[inside], inside


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def words_of(data: np.ndarray, sizes: np.ndarray) -> Words:
    """The words of texts of the given sizes in bytes, laid end to end in ``data``."""
    edge = np.append(0, np.cumsum(sizes))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    at_edge = edge[:-1][sizes > 0]
    begins[at_edge] = ~blank[at_edge]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64))
    # a word ends at the next blank or where its text ends
    stop_at = np.flatnonzero(blank)
    next_blank = np.append(stop_at, len(data))[np.searchsorted(stop_at, start)]
    text_end = edge[np.searchsorted(edge, start, "right")]
    size = np.minimum(next_blank, text_end) - start
    hashes = np.empty(len(start), np.uint64)
    upto = np.cumsum(size)
    for at, end in slices(size, HASHED_BYTES):
        own = size[at:end]
        begin = upto[at:end] - own - (upto[at] - own[0])
        offset = np.arange(begin[-1] + own[-1], dtype=np.int64) - np.repeat(begin, own)
        codes = data[offset + np.repeat(start[at:end], own)]
        factor = _FACTORS[offset] if own.max() <= len(_FACTORS) else mixed(offset + (9 << 40)) | np.uint64(1)
        factor *= _BYTES[codes]
        hashes[at:end] = mixed(np.add.reduceat(factor, begin))
    return Words(data, start, size, hashes, np.searchsorted(start, edge))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the size of each text; a null text is empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = whole.buffers()
    if data is None or not len(whole):
        return np.zeros(0, np.uint8), sizes
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], sizes


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or of one row that is larger."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, end
        at = end


def planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of integers, all lowest bytes first: sorted numbers then compress well."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def from_planes(data: bytes, width: int, dtype) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)
