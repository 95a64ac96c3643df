"""Suffix order and longest common prefixes of word sequences, many rows at once.

Prefix doubling that sorts, in each round, only the suffixes that still share a bucket, by the bucket of the suffix
2**k words on. Rows never share a bucket. The words' order is that of their hashes.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.bytes import pair


def repeated_prefixes(tokens: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, words of its longest prefix that starts elsewhere in its row), where those are two or more.

    The value is the larger of the suffix's two neighbouring longest-common-prefix values, so the spans
    [suffix, suffix + value) are the occurrences of maximal repeated strings.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(tokens)
    if n < 2:
        return none, none
    key = pair(tokens, row.astype(np.uint64), 21)
    live = np.argsort(key, kind="stable")
    bucket = np.zeros(n, dtype=np.int64)
    first = np.zeros(n, dtype=np.int64)
    levels: list[np.ndarray] = []
    step = 0
    while len(live):
        if step:
            on = live + step
            second = np.where(on < end[live], bucket[np.minimum(on, n - 1)] + 1, 0)
            key = first * (n + 1) + second
            order = np.argsort(key, kind="stable")
            live, first, key = live[order], first[order], key[order]
        else:
            key = key[live]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(live)))
        # a bucket keeps its number; its parts are numbered by where they start in it
        old = np.concatenate([[True], first[1:] != first[:-1]]) if step else np.zeros(len(live), dtype=bool)
        old[0] = True
        base = np.maximum.accumulate(np.where(old, np.arange(len(live)), 0))
        number = np.repeat(first[begin] + begin - base[begin], size)
        bucket = bucket.copy()
        bucket[live] = number
        levels.append(bucket)
        many = np.repeat(size > 1, size)
        live, first = live[many], number[many]
        step = step * 2 or 1
    if len(levels) < 2:
        return none, none
    order = np.argsort(bucket, kind="stable")
    a, b = order[:-1], order[1:]
    near = levels[1][a] == levels[1][b]
    a, b = a[near], b[near]
    got = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + got, b + got
        ok = (x < end[a]) & (y < end[b])
        ok &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        got[ok] += 1 << k
    value = np.zeros(n, dtype=np.int64)
    np.maximum.at(value, a, got)
    np.maximum.at(value, b, got)
    places = np.flatnonzero(value)
    return places, value[places]
