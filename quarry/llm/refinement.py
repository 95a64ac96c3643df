"""Windows that occur twice in a set of byte strings, by bucket-pointer refinement.

The first buckets hold the positions with equal q-grams, q bytes read as one number. A round sorts every bucket by the
bucket numbers `depth` bytes on and gives its parts new numbers, which the next round points to in turn, so each round
doubles the bytes that a bucket's members share. A window that holds the only position of a bucket occurs once; its
positions take no part in later rounds. Numbers stand for bytes that are equal, not for hashes.
"""

from __future__ import annotations

import numpy as np

GRAM = 8


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of equal keys, and which keys are alone."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    alone = np.empty(len(key), dtype=bool)
    alone[order] = new & np.append(new[1:], True)
    return number, alone


def _spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions in [s, s + width) for any start s."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def repeated_windows(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows [start, start + length) of buf occur at two or more of the starts."""
    n, q = len(buf), min(GRAM, length)
    live = np.arange(len(starts))
    if not len(starts):
        return np.zeros(len(starts), dtype=bool)
    gram = np.zeros(n - q + 1, dtype=np.uint64)
    for k in range(q):
        gram = gram << np.uint64(8) | buf[k : n - q + 1 + k].astype(np.uint64)
    bucket = np.zeros(n, dtype=np.int64)
    depth = q
    at = _spread(starts, length - q + 1, n)
    bucket[at], alone = _split(gram[at])
    while True:
        single = np.zeros(n + 1, dtype=np.int32)
        single[1:][at[alone]] = 1
        np.cumsum(single, out=single)
        s = starts[live]
        live = live[single[s + length - depth + 1] == single[s]]
        if depth == length or not len(live):
            break
        step = min(depth, length - depth)
        depth += step
        at = _spread(starts[live], length - depth + 1, n)
        bucket[at], alone = _split(bucket[at] * (n + 1) + bucket[at + step])
    out = np.zeros(len(starts), dtype=bool)
    out[live] = True
    return out
