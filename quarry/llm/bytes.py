"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Everything here takes the value buffer of a batch as it came from the JVM, so no Python string is made. Batches are
cut into runs of whole rows of about CHUNK bytes, which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240607))
#: A random odd-free code for every byte value; polynomial hashes of these codes modulo 2**64.
CODES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, CHUNK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(m, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about chunk bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and the n + 1 offsets of the rows among the words."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    letter = np.zeros(n + 2, dtype=np.int8)
    np.logical_not(_SPACES[buf], out=letter[1:-1].view(bool))
    edge = np.diff(letter)
    begins, ends = edge == 1, edge == -1
    inner = offsets[(offsets > 0) & (offsets < n)]
    # a row's edge parts two words that touch
    touch = inner[(letter[inner] == 1) & (letter[inner + 1] == 1)]
    begins[touch] = True
    ends[touch] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends), np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, of A-Z lower-cased unless told otherwise."""
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        codes = (CODES[LOWER] if lower else CODES)[buf]
        codes *= up[: len(buf)]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(codes, out=total[1:])
        h = (total[end] - total[start]) * down[start]
    return mixed(h + (end - start).astype(np.uint64))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F), seed)
