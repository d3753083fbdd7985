"""Words and their hashes for whole batches of UTF-8 texts, in numpy.

A word is a longest run of bytes other than the space and 0x09-0x0D, within one text. Hashes
are polynomials in an odd base modulo 2**64, taken from prefix sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from webstrata.llm.workers import cache

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
BASE = 0xD6E8FEB86659FD93
_PIECE = 1 << 18


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_KEPT = _PIECE + (1 << 16)
_powers: dict[int, np.ndarray] = cache()


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; as many as a piece needs are kept for a task."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, 1024), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if count <= _KEPT:
            _powers[base] = have
    return have[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray,
                 base: int = BASE) -> np.ndarray:
    """Polynomial hash of ``values[b:e]`` for each pair, the lowest position first."""
    prefix = np.empty(len(values) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=prefix[1:])
    return (prefix[ends] - prefix[begins]) * powers(inverse(base), len(values) + 1)[begins]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a batch of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False,
                 hashed: bool = True) -> None:
        inside = ~_IS_SPACE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[firsts] = inside[firsts]
        end[lasts] = inside[lasts]
        self.begins, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begins, offsets)
        self.counts = np.diff(self.first)
        if hashed:
            self.hashes = self._hash(_FOLD[data] if fold_case else data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.begins), dtype=np.uint64)
        at = 0
        while at < len(out):  # pieces keep the arrays small, whatever a text's length
            low = self.begins[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _PIECE, "right")))
            begins, ends = self.begins[at:to] - low, self.ends[at:to] - low
            values = _BYTE_VALUE[data[low:low + ends[-1]]]
            out[at:to] = mix(range_hashes(values, begins, ends)
                             + (ends - begins).astype(np.uint64) * _GOLDEN)
            at = to
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words within one text, and their hashes."""
        total = len(self.hashes)
        last = np.repeat(self.first[1:], self.counts)
        begins = np.flatnonzero(np.arange(total) + size <= last)
        out = np.empty(len(begins), dtype=np.uint64)
        for at in range(0, len(begins), _PIECE):
            part = begins[at:at + _PIECE]
            low, high = part[0], part[-1] + size
            out[at:at + _PIECE] = mix(range_hashes(
                self.hashes[low:high], part - low, part - low + size))
        return begins, out


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
