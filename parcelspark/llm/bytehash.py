"""Words and their hashes over whole Arrow batches with numpy: no Python step per word or byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_odd = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once, or one document if that is longer.
CHUNK = 2 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def at_place(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A number for a byte at its place in a word: independent of those of other places, unlike powers of a base."""
    return mix((place.astype(U) << U(8) | byte) * _odd + _odd)


#: at_place() of the first places.
PLACES = 64
PLACE = np.stack([at_place(np.full(256, i), np.arange(256, dtype=np.uint8)) for i in range(PLACES)])


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK >> 1)  # a word and the space behind it are two bytes at least
        base = 0xD6E8FEB86659FD93
        inverse = pow(base, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U))]) for b in (U(base), U(inverse))]
    return _powers


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of rows [lo, hi): starts, ends (in `buf`), `first` (n + 1 word offsets of the rows)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        self.buf = LOWER[buf] if lower else buf
        ink = ~SPACE[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True  # words end at the end of a row
        starts = ink.copy()
        starts[1:] &= ~ink[:-1] | edge[1:-1]
        ends = ink.copy()
        ends[:-1] &= ~ink[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64 bits that name each word: the sum of its bytes' numbers, mixed with its length."""
        size = self.ends - self.starts
        if not len(size):
            return np.zeros(0, U)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = self.buf[place + np.repeat(self.starts, size)]
        near = np.minimum(place, PLACES - 1)
        number = PLACE[near, byte]
        far = np.flatnonzero(place >= PLACES)
        number[far] = at_place(place[far], byte[far])
        return mix(np.add.reduceat(number, first) + size.astype(U) * _odd)

    def endings(self) -> np.ndarray:
        """The last two bytes of each word as a number."""
        last = self.buf[self.ends - 1].astype(np.int64)
        return last | np.where(self.ends - self.starts > 1, self.buf[np.maximum(self.ends - 2, 0)].astype(np.int64) << 8, 0)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` successive values (windows across rows included)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n] + U(width * int(_odd) & (1 << 64) - 1))


def sequence(h: np.ndarray) -> np.uint64:
    """The hash of one whole sequence."""
    return windows(h, len(h))[0]


def rows(batches: Iterator[pa.RecordBatch], text: str, lower: bool) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Pieces of the batches with their words."""
    for batch in batches:
        buf, off = texts(batch.column(text))
        for lo, hi in chunks(off):
            yield batch.slice(lo, hi - lo), Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
