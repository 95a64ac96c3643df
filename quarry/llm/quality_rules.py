"""Quality rules on repetition inside a text, by suffix order and longest common prefixes of its words.

Maximal repeated word strings of `least` words or more are found for every whole text; the union of their spans and
the longest of them are limited. The basic counts follow the SQL contract.

Defined results: a null, empty or blank text has no words and fails; ties have no effect; repeated rows are judged
alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.llm import suffixes as S
from quarry.llm.anchors import prefix_hash, string_hash

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(buf: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    row = np.searchsorted(offsets, start, side="right") - 1
    # a line that would start where its row ends is empty, and empty rows have none with a word
    ok = (row < n) & (start < len(buf))
    start, row = start[ok], row[ok]
    nl = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(buf))[nl], offsets[row + 1])
    worded = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, row = start[worded], end[worded], row[worded]
    if not len(start):
        return np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = B.mixed(string_hash(prefix_hash(buf), start, end) + (end - start).astype(np.uint64))
    _, first = np.unique(B.pair(h, row.astype(np.uint64), 22), return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def measures(buf: np.ndarray, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """The columns NAMES of rows that lie end to end."""
    n = len(offsets) - 1
    start, end, at = B.words(buf, offsets)
    h = B.word_hashes(buf, start, end, lower=False)
    n_words = np.diff(at)
    whole = ((buf & 0xC0) != 0x80) & ~B._SPACES[buf]
    out = [n_words, _row_sums(whole, offsets), _row_sums(_SYMBOLS[buf], offsets), _dup_lines(buf, offsets, start)]
    row = np.repeat(np.arange(n), n_words)
    last = np.repeat(at[1:], n_words)
    suffix, value = S.repeated_prefixes(h, row, last)
    hit = np.zeros(len(h), dtype=bool)
    for k in range(3):
        hit[suffix[value >= 3] + k] = True
    out.append(_row_sums(hit, at))
    suffix, value = suffix[value >= least], value[value >= least]
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, row[suffix], value)
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, suffix, 1)
    np.add.at(edge, suffix + value, -1)
    out += [_row_sums(np.cumsum(edge)[:-1] > 0, at), longest]
    return out


def _measurer(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                got = measures(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                columns = [pa.array(x.astype(np.int64)) for x in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], names=["doc_id", *NAMES])

    return run


def judged(docs: DataFrame, least: int = 8, most_covered: float = 0.4, longest_share: float = 0.25, min_words: int = 50) -> DataFrame:
    """Per document: doc_id, the basic counts (a repeated 3-word window is a repeat of three words or more), base_failed, kept, covered_words, longest_repeat.

    Kept are texts that pass the base rules, with at most most_covered of their words in maximal repeats of `least`
    words or more, and no repeat longer than longest_share of the text.
    """
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scan.mapInArrow(_measurer(least), "doc_id long, " + ", ".join(f"{c} long" for c in NAMES))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    fine = (F.col("covered_words") <= F.col("n_words") * most_covered) & (F.col("longest_repeat") <= F.col("n_words") * longest_share)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
