"""Anchors of windows: which window of a text can equal which other, at a fraction of the rows.

A window is `length` consecutive items (bytes or words) of one text.  Its anchor is the run of `gram`
items within it with the smallest hash, the leftmost of equals.  Equal windows have equal anchors at
equal places, so only texts that share an anchor's hash can share a window with that anchor.  An
anchor's context is every item that any window with that anchor could cover: texts with equal
contexts share all these windows.
"""

import numpy as np

from recordloom.llm import textkit as tk

#: Bits of a packed place that hold each of the two offsets of an anchor's windows.
SHIFT = 8


def leftmost_min(g: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the smallest of the next `width` values is, the leftmost of equals."""
    n = len(g) - width + 1
    value, at, size = g, np.arange(len(g), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        m = len(value) - step
        left = value[:m] <= value[step : step + m]
        value, at = np.where(left, value[:m], value[step : step + m]), np.where(left, at[:m], at[step : step + m])
        size += step
    return at[:n]


def find(codes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: row, gram hash, context hash, and the packed place (see `pack`).

    Consecutive windows with one anchor are one result.
    """
    width = length - gram + 1
    h = tk.RangeHash(codes)
    n = len(codes)
    none = (np.zeros(0, np.int64),) * 4
    if n < length:
        return none
    start = np.arange(n - gram + 1)
    g = h(start, start + gram)
    row = tk.row_of(first)
    p = np.flatnonzero(np.arange(n - length + 1) + length <= first[row[: n - length + 1] + 1])
    if not len(p):
        return none
    q = leftmost_min(g, width)[p].astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (q[1:] != q[:-1]) | (row[p][1:] != row[p][:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    q, low, high = q[at], p[at], p[last]
    r = row[q]
    begin, end = np.maximum(first[r], q - width + 1), np.minimum(first[r + 1], q + length)
    context = h(begin, end) ^ tk.mix((q - begin) * 4096 + (end - q))
    return r, g[q], context, pack(q - first[r], q - low, q - high)


def pack(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An anchor's place in its text, and how far before it its first and last windows start."""
    return (place << (2 * SHIFT)) | (low << SHIFT) | high


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << SHIFT) - 1
    return packed >> (2 * SHIFT), (packed >> SHIFT) & mask, packed & mask
