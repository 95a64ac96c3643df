"""Anchors: positions that any two equal byte strings of a given length share.

Every window of `length` bytes holds length - q + 1 q-grams; the one with the smallest hash (the first of equals) is
the window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets.
"""

from __future__ import annotations

import numpy as np

from quarry.llm import bytes as B

_POS = np.uint64((1 << 22) - 1)
#: Rows longer than this are handled in overlapping segments.
SEGMENT = 1 << 18


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """total, so that string_hash(total, start, end) hashes any substring."""
    up, _ = B.powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        codes = B.CODES[buf]
        codes *= up[: len(buf)]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(codes, out=total[1:])
    return total


def string_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = B.powers(len(total))
    with np.errstate(over="ignore"):
        return B.mixed((total[end] - total[start]) * down[start], 3)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(offsets: np.ndarray, length: int):
    """(row range, first byte, bytes, row offsets) of runs of rows; a long row comes in overlapping segments."""
    for i, j in B.runs(offsets, SEGMENT):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * SEGMENT:
            yield i, j, a, b, offsets[i : j + 1] - a
            continue
        for at in range(a, b, SEGMENT):
            end = min(at + SEGMENT + length - 1, b)
            yield i, j, at, end, np.array([0, end - at], dtype=np.int64)


def owners(total: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their anchors' positions, hash of every q-gram) of whole rows that lie end to end."""
    n = len(total) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - q + 1, dtype=np.int64)
    grams = string_hash(total, at, at + q)
    rank = (grams & ~_POS) | at.astype(np.uint64)
    low = sliding_min(rank, length - q + 1)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    starts = np.flatnonzero(np.arange(len(low)) + length <= row_end)
    return starts, (low[starts] & _POS).astype(np.int64), grams
