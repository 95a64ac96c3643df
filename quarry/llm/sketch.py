"""Fast similarity sketching: rounds of hashed bin placement that leave no coordinate empty.

In round i < t every element falls into one hashed bin with a value in [i, i + 1); in round t + j the elements all
fall into bin j. A coordinate keeps its smallest value, so later rounds only matter to bins that earlier ones left
empty, and after round 2t - 1 every coordinate of a non-empty set is filled. Two sets agree in a coordinate with the
probability of their Jaccard similarity, with the concentration of t independent draws.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.bytes import mixed

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(items: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """(rows, t) values for the sets items[offsets[i]:offsets[i + 1]]; an empty set keeps empty coordinates."""
    n = len(offsets) - 1
    out = np.full(n * t, _EMPTY, dtype=np.uint64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    live = items
    for i in range(t):
        if not len(live):
            break
        h = mixed(live, 101 + i)
        at = owner * t + ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        value = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        if i:
            free = out[at] >= np.uint64(i << 32)
            at, value = at[free], value[free]
        np.minimum.at(out, at, value)
        open_rows = (out.reshape(n, t) == _EMPTY).any(axis=1) & (size > 0)
        keep = open_rows[owner]
        live, owner = live[keep], owner[keep]
    table = out.reshape(n, t)
    for row in np.flatnonzero((table == _EMPTY).any(axis=1) & (size > 0)):
        own = items[offsets[row] : offsets[row + 1]]
        for j in np.flatnonzero(table[row] == _EMPTY):
            table[row, j] = np.uint64((t + int(j)) << 32) | (mixed(own, 101 + t + int(j)) & np.uint64(0xFFFFFFFF)).min()
    return table


def band_keys(table: np.ndarray, rows_per_band: int) -> np.ndarray:
    """(rows, bands) hashes of consecutive runs of coordinates."""
    n, t = table.shape
    bands = t // rows_per_band
    with np.errstate(over="ignore"):
        key = np.tile(mixed(np.arange(bands, dtype=np.uint64), 7), (n, 1))
        for r in range(rows_per_band):
            key = mixed(key * np.uint64(0x9FB21C651E98DF25) + table[:, r : bands * rows_per_band : rows_per_band], 11 + r)
    return key
