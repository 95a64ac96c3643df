"""Sets of distinct word shingles, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from quarry.llm import bytes as B


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row and their n + 1 offsets.

    A row with fewer words than width has its whole sequence as its one shingle; a row without words has none.
    """
    start, end, at = B.words(buf, offsets)
    h = B.word_hashes(buf, start, end)
    n = len(offsets) - 1
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    joined = h
    for step in range(1, width):
        joined = B.pair(joined[:-1], h[step:], step) if len(joined) > 1 else joined[:0]
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = h[a : a + 1]
            for step in range(1, b - a):
                own = B.pair(own, h[a + step : a + step + 1], step)
            own = B.mixed(own, 1000 + int(b - a))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    items = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return items, np.concatenate([[0], np.cumsum(sizes)])
