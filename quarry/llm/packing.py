"""Packing into length buckets whose bounds minimise padding, with token-budget batches in each bucket.

Documents over `max_len` words become pieces of at most `max_len`. The histogram of piece lengths, at most `max_len`
rows, goes to the driver, where dynamic programming picks the bucket bounds. Rows keep their order inside a bucket:
that of the files they were read from, so that the batches of a mix follow its schedule. Ranks are counted file by
file and offset, so a bucket that holds most rows still spreads over the cluster.

Defined results: a document without words (null or empty text) is one row with n_words 0, bucket 0 and null batch;
repeated rows are packed as often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.scratch import located, staged

#: Parts of a file's rows in which a bucket's rows are ranked together, by their place.
RANKED = 1 << 16


def best_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets with the least padding over the histogram of lengths."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    m = len(lengths)
    upto = np.concatenate([[0.0], np.cumsum(counts)])
    words = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(n_buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            # bucket of lengths i..j-1, padded to the longest
            cost = best[:j] + (upto[j] - upto[:j]) * lengths[j - 1] - (words[j] - words[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    bounds, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def _piecer(max_len: int, texts: bool):
    """Pieces of documents: file, place, doc_id, piece, first, n_words, and with texts the piece's text.

    A piece's text ends where the next piece's first word begins, so the pieces of a document make up its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                part = buf[offsets[i] : offsets[j]]
                at_byte = offsets[i : j + 1] - offsets[i]
                start, _, at = B.words(part, at_byte)
                n = np.diff(at)
                count = np.maximum(-(-n // max_len), 1)
                own = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                first = piece * max_len
                columns = [batch.column(c).slice(i, j - i).take(pa.array(own)) for c in ("file", "place", "doc_id")]
                columns += [pa.array(piece), pa.array(first), pa.array(np.minimum(n[own] - first, max_len))]
                names = ["file", "place", "doc_id", "piece", "first", "n_words"]
                if texts:
                    begin = at_byte[own]
                    later = np.flatnonzero(piece)
                    begin[later] = start[at[own[later]] + first[later]]
                    ends = np.append(begin[1:], at_byte[-1])
                    raw = part.tobytes()
                    columns.append(pa.array([raw[a:b].decode() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], type=pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, max_len: int = 2048, n_buckets: int = 16, batch_tokens: int = 65536, texts: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, first (word), n_words, bucket (padded length), batch, slot in the batch; texts: text too.

    A batch holds batch_tokens // bucket rows of its bucket; batches are numbered in each bucket.
    """
    docs, file, place = located(docs, "pack-docs")
    scan = docs.select(file.alias("file"), place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "file string, place long, doc_id long, piece long, first long, n_words long"
    sizes = staged(scan.mapInArrow(_piecer(max_len, False), kind).select("file", "place", "n_words"), "pack-sizes")
    histogram = {int(r[0]): int(r[1]) for r in sizes.where("n_words > 0").groupBy("n_words").count().collect()}
    bounds = best_bounds(histogram, n_buckets)
    bucket = F.coalesce(*[F.when(F.col("n_words") <= b, F.lit(b)) for b in [0, *bounds]]).cast("long").alias("bucket")
    part = F.floor(F.col("place") / RANKED).alias("part")
    sums = sizes.select(bucket, "file", part).groupBy("bucket", "file", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select("bucket", "file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "pack-offsets")
    pieces = scan.mapInArrow(_piecer(max_len, texts), kind + ", text string" * texts).select("*", bucket, part)
    rank = F.row_number().over(Window.partitionBy("bucket", "file", "part").orderBy("place", "piece")) - 1
    ranked = pieces.withColumn("r", rank).join(sums, ["bucket", "file", "part"]).withColumn("r", F.col("r") + F.col("offset"))
    rows = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket")), F.lit(1)).cast("long")
    full = F.col("bucket") > 0
    return ranked.select(
        "doc_id",
        "piece",
        "first",
        "n_words",
        "bucket",
        F.when(full, F.floor(F.col("r") / rows)).cast("long").alias("batch"),
        F.when(full, F.col("r") % rows).cast("long").alias("slot"),
        *(["text"] if texts else []),
    )
