"""Document fingerprints: a quartile digest of hashed byte triplets.

Every byte triplet of a text adds one to one of `BUCKETS` hashed buckets. A bucket's two bits say in which quarter of
the text's own counts it lies; a byte for the length, on a scale of ratios, comes first. Likeness is one less the
bounded difference: per bucket 0, 1, 2, or 6 for opposite ends, and a bounded term for the lengths.

Defined results: a null or empty text has the digest of no triplets; equal texts have equal digests; rows that repeat
a doc_id follow each other in the order of their texts; a null doc_id sorts first; the only row is its own next; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.scratch import staged

BUCKETS = 1024
#: The difference that counts as no likeness at all, and what each step of length adds, up to LENGTH_STEPS.
WORST = BUCKETS * 3 // 2
LENGTH_STEPS = 16
LENGTH_COST = BUCKETS // 128
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)


def codes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 1 + BUCKETS): the length step and every bucket's quarter."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, dtype=np.int64)
    size = np.diff(offsets)
    if len(buf) > 2:
        x = buf.astype(np.uint32)
        x = x[:-2] | x[1:-1] << 8 | x[2:] << 16
        with np.errstate(over="ignore"):
            at = (x * np.uint32(0x9E3779B1) >> np.uint32(32 - 10)).astype(np.int64)
        row = np.repeat(np.arange(n), size)[:-2]
        inside = np.arange(len(buf) - 2) + 2 < offsets[row + 1]
        counts = np.bincount((row * BUCKETS + at)[inside], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts.astype(np.int32), axis=1)
    out = np.zeros((n, 1 + BUCKETS), dtype=np.uint8)
    for k in (1, 2, 3):
        out[:, 1:] += counts > ordered[:, k * BUCKETS // 4 - 1 : k * BUCKETS // 4]
    out[:, 0] = np.round(np.log(np.maximum(size, 1)) / np.log(1.1)).astype(np.int64) % 256
    return out


def packed(code: np.ndarray) -> list[str]:
    quads = code[:, 1:].reshape(len(code), -1, 4)
    body = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
    raw = np.concatenate([code[:, :1], body.astype(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def unpacked(digests: list[str]) -> np.ndarray:
    raw = np.array([np.frombuffer(base64.b64decode(d), dtype=np.uint8) for d in digests]).reshape(len(digests), -1)
    body = np.stack([raw[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digests), -1)
    return np.concatenate([raw[:, :1], body], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of codes."""
    apart = _COST[a[:, 1:], b[:, 1:]].sum(axis=1)
    steps = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0].astype(np.int64)), LENGTH_STEPS)
    return 1.0 - np.minimum(apart + steps * LENGTH_COST, WORST) / WORST


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _all_codes(texts: list[bytes]) -> np.ndarray:
    buf, offsets = _joined(texts)
    parts = [codes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.runs(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 1 + BUCKETS), np.uint8)


def edited(this: str, other: str) -> tuple[str, int]:
    """this, with its last half replaced by as much of the start of other; its length in code points."""
    n = len(this)
    return this[: n - n // 2] + other[: n // 2], n


def _results(texts: list[str], nexts: list[str], own: np.ndarray, other: np.ndarray) -> dict[str, list]:
    pairs = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
    new = [t.encode() for t, _ in pairs]
    code = _all_codes(new)
    return {
        "n_chars": [n for _, n in pairs],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in new],
        "fingerprint": packed(own),
        "edited_fingerprint": packed(code),
        "near_edited": likeness(own, code),
        "near_next": likeness(own, other),
    }


KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
EDGE = {"edge": pa.int32(), "pid": pa.int32(), "text": pa.string()}


def _batch(n: int, values: dict[str, list]) -> pa.RecordBatch:
    kinds = EDGE | KINDS
    return pa.RecordBatch.from_arrays([pa.array(values[c], type=k) if c in values else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of sorted rows, each with the next; the first and the last row of the partition go on with their text."""
    pid, last = TaskContext.get().partitionId(), None
    for whole in batches:
        _, offsets = B.values(whole.column("text"))
        for i, j in B.runs(offsets):
            ids, texts = whole.column("doc_id").slice(i, j - i).to_pylist(), [t or "" for t in whole.column("text").slice(i, j - i).to_pylist()]
            own = _all_codes([t.encode() for t in texts])
            if last is None:
                yield _batch(1, {"edge": [1], "pid": [pid], "text": texts[:1], "doc_id": ids[:1]})
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            if len(texts) > 1:
                yield _batch(len(texts) - 1, {"edge": [0] * (len(texts) - 1), "doc_id": ids[:-1]} | _results(texts[:-1], texts[1:], own[:-1], own[1:]))
            last = ids[-1], texts[-1], own[-1:]
    if last is not None:
        yield _batch(1, {"edge": [2], "pid": [pid], "text": [last[1]], "doc_id": [last[0]]})


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, nexts = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "next_text"))
        own, other = _all_codes([t.encode() for t in texts]), _all_codes([t.encode() for t in nexts])
        values = {"doc_id": batch.column("doc_id").to_pylist()} | _results(texts, nexts, own, other)
        yield pa.RecordBatch.from_arrays([pa.array(values[c], type=k) for c, k in KINDS.items()], names=list(KINDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                got = packed(codes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(got)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edits(docs: DataFrame) -> DataFrame:
    """Per document, against its edited text and the next document by doc_id: the columns of the SQL contract.

    Documents are dealt by ranges of doc_id and sorted there, so each meets its next; only the last row of a range
    looks for the first of the next range.
    """
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = scan.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    kinds = "edge int, pid int, text string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = staged(dealt.mapInArrow(_in_order, kinds), "digest-rows", codec="zstd")
    order = Window.orderBy("pid")
    heads = found.where("edge = 1").select("pid")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per range: the range before it, and for the first the last
    heads = heads.select("pid", F.coalesce(F.lag("pid").over(order), F.max("pid").over(everything)).alias("before"))
    first = found.where("edge = 1").select("pid", F.col("text").alias("next_text")).join(heads, "pid").select("before", "next_text")
    tails = found.where("edge = 2").select("pid", "doc_id", "text")
    ends = tails.join(first, tails["pid"] == first["before"]).select("doc_id", "text", "next_text")
    ends = ends.mapInArrow(_across, kinds.split("text string, ")[1])
    return found.where("edge = 0").select(*KINDS).unionByName(ends)
