"""Texts of an Arrow batch as byte arrays: words, and hashes of any byte span in constant time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Blank and the control characters 9 to 13; all are single bytes in UTF-8.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes handled at a time, unless one text is longer.
CHUNK_BYTES = 1 << 20


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, with len + 1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: index of the first text, bytes, offsets."""
    data, offsets = bytes_of(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def spans(stops: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not ``stops`` within each text: starts, ends, text index."""
    n = len(stops)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inner = ~stops
    before = np.empty(n, bool)
    before[0], before[1:] = True, stops[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, stops[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before[edge] = True
    after[edge - 1] = True
    starts = np.flatnonzero(inner & before)
    return starts, np.flatnonzero(inner & after) + 1, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: starts, ends, text index."""
    return spans(WHITE[data], offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """64-bit hashes of byte spans by differences of one running polynomial sum.

    Bytes are first replaced by random 64-bit values; ``seed`` picks those and the base.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        power, self.inverse = self._known(base, len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(table[data] * power[:len(data)], out=self.sums[1:])

    @classmethod
    def _known(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(base)
        if known is None or len(known[0]) < n:
            size = max(n, CHUNK_BYTES + 1)
            known = tuple(_powers(b, size) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 2 * CHUNK_BYTES:
                cls._powers[base] = known
        return known

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal spans have equal hashes, whatever their place."""
        x = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(x + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)
