"""Vectorised text primitives for Arrow batches: words, hashes, chunks.

Texts are handled as UTF-8 bytes of whole Arrow string columns, so that no Python loop runs per
word or character.  All sums and products are modulo 2**64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step handles, unless a single text is longer.
CHUNK_BYTES = 1 << 18
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_CODE_LOWER = BYTE_CODE[LOWER]


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class RangeHash:
    """Hashes of any range of a sequence of 64-bit codes, each in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's bytes start; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(data: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `size` bytes: first row, row after the last, bytes, row starts."""
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within rows: starts, ends, and the index of each row's first run."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, and the index of each row's first word."""
    return spans(~WHITE[data], at)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit code a word, equal for equal words."""
    return RangeHash((BYTE_CODE_LOWER if lower else BYTE_CODE)[data])(starts, ends)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of `width` items that stay within a row, and the row of each."""
    rows = row_of(first)
    start = np.flatnonzero(np.arange(len(codes)) + width <= first[rows + 1]) if len(codes) else np.zeros(0, np.int64)
    return start, rows[start]


def shingle_codes(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of `width` items, with rows; a shorter non-empty row is one shingle."""
    h = RangeHash(codes)
    start, rows = windows(codes, first, width)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    out = np.concatenate([h(start, start + width), h(first[short], first[short + 1])])
    rows = np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return out[order], rows[order]


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)
