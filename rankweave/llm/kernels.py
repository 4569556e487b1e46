"""Array kernels over the bytes of many texts at once: words, lines and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

# ASCII white space, and the ASCII characters that belong to a license word.
SPACES = b" \t\n\x0b\x0c\r"
ASCII_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"


def table(members: bytes, high: bool = False) -> np.ndarray:
    """A lookup by byte; ``high`` is the answer for bytes of non-ASCII characters."""
    out = np.zeros(256, bool)
    out[128:] = high
    out[np.frombuffer(members, np.uint8)] = True
    return out


IS_SPACE = table(SPACES)
IS_WORD = ~IS_SPACE
IS_ALNUM = table(ASCII_WORD, high=True)
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes: first row, end row, bytes, offsets.

    A text is never split; one beyond the limit is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its text does."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    starts = np.flatnonzero(member & (~before | first[:n]))
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-separated lines, and the row each belongs to."""
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    start_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, start_row))
    starts, row = starts[order], start_row[order]
    ends = ends[np.lexsort((ends, start_row))]
    return starts, ends, row


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype == bool else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (the murmur3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Roller:
    """Polynomial hashes of any span of a sequence of 64-bit values."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(SLICE_BYTES, n) + 1
            step = np.full(size, U64(self.base))
            step[0] = 1
            back = np.full(size, U64(self.inverse))
            back[0] = 1
            self.powers, self.inverses = np.cumprod(step), np.cumprod(back)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n)
        out = np.zeros(n + 1, U64)
        np.cumsum(values * self.powers[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end); equal spans have equal hashes wherever they stand."""
        self._grow(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Mixed hashes of all spans of ``width`` values."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mix((prefix[width:] - prefix[:-width]) * self.inverses[:n])


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for every byte, so that the hash isn't linear in bytes."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


BYTE_VALUES = byte_values(20)
BYTES = Roller(0x9E3779B97F4A7C15)
WORDS = Roller(0xD1342543DE82EF95)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = BYTES.prefix(BYTE_VALUES[data])
    return BYTES.spans(prefix, starts, ends) ^ mix((ends - starts).astype(U64))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
