"""Groups of similar chunks: blocked similarity join, pair rules, components, mean scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import unit_vectors
from quarry.operators.blocks import met, packed
from quarry.operators.components import components, lowest
from quarry.scratch import nullable, staged

BLOCK = 4096
#: Rows of a block that meet the other block in one matrix product.
TILE = 512
#: Pairs that are told as one row per node at a time.
GATHERED = 1 << 21
REASON = "similar embeddings"


def matches(languages: Sequence[str] = (), min_lines: int = 0, max_lines: int = 0, path_prefixes: Sequence[str] = (), node_types: Sequence[str] = ()) -> Column:
    """Chunk filter; an empty list or 0 leaves that side open."""
    lines = F.col("end_line") - F.col("start_line") + 1
    keep = F.lit(True)
    if languages:
        keep &= F.col("language").isin(*languages)
    if min_lines:
        keep &= lines >= min_lines
    if max_lines:
        keep &= lines <= max_lines
    if node_types:
        keep &= F.col("node_type").isin(*node_types)
    if path_prefixes:
        starts = F.lit(False)
        for p in path_prefixes:
            starts |= F.col("file_path").startswith(p)
        keep &= starts
    return keep


def trivial(a: str = "a", b: str = "b") -> Column:
    """Pairs that say nothing: overlapping ends in one file, or a chunk of under three lines."""
    c = lambda side, name: F.col(f"{side}.{name}")
    same = (c(a, "file_path") == c(b, "file_path")) & ((c(a, "start_line") == c(b, "start_line")) | (c(a, "end_line") == c(b, "end_line")))
    short = lambda side: c(side, "end_line") - c(side, "start_line") + 1 < 3
    return same | short(a) | short(b)


def paired(rows: DataFrame, threshold: float, key: str, vector: str = "embedding", carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(a, b, score) of all rows with keys a < b and cosine >= threshold; a and b are structs of the key and the columns of carry.

    Rows are packed into blocks and every two blocks meet in matrix products, so a task holds two blocks, no vector is
    copied for its partners, and only pairs over the threshold come out. Null and zero vectors pair with nothing;
    vectors of other lengths than their partner's have similarity 0.
    """
    names = [key, *(c for c in carry if c != key)]
    single = rows.schema[vector].dataType == T.ArrayType(T.FloatType(), rows.schema[vector].dataType.containsNull)
    value = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*names, value.alias("__vector"))
    struct = nullable(T.StructType([rows.schema[c] for c in names]))

    def product(one: pa.Table, two: pa.Table, same: bool) -> Iterator[pa.Table]:
        both = pa.concat_tables([one, two]).select(names).combine_chunks()
        keys = both.column(key)
        left, right = unit_vectors(one.column("__vector")), unit_vectors(two.column("__vector"))
        for width in left.keys() & right.keys():
            (p, m), (q, w) = ((at[some], v[some]) for at, v in (left[width], right[width]) for some in [(v != 0).any(axis=1)])
            for first in range(0, len(p), TILE):
                s = m[first : first + TILE] @ w.T
                x, y = np.nonzero(s >= threshold)
                s, x, y = s[x, y], p[first + x], q[y] + one.num_rows
                less = pc.less(keys.take(pa.array(x)), keys.take(pa.array(y))).to_numpy()
                more = pc.greater(keys.take(pa.array(x)), keys.take(pa.array(y))).to_numpy() & (not same)
                lower, upper, kept = np.where(less, x, y), np.where(less, y, x), less | more
                ends = [both.take(pa.array(end[kept])).to_struct_array() for end in (lower, upper)]
                yield pa.table({"a": ends[0], "b": ends[1], "score": pa.array(s[kept])})

    kind = T.StructType([T.StructField("a", struct), T.StructField("b", struct), T.StructField("score", T.DoubleType())])
    return met(packed(rows, "__vector", block, "vectors"), None, product, kind)


def similar_pairs(rows: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, score) for all keys a < b with cosine >= threshold; as paired."""
    return paired(rows, threshold, key, vector, block=block).select(F.col("a")[key].alias("a"), F.col("b")[key].alias("b"), "score")


def _gathered(src: str, dst: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every chunk of pairs and each node in it: the smallest node it reaches there, and sum and number of the scores of its pairs as src."""

    def rows(pairs: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs = pairs.filter(pc.and_(pc.is_valid(pairs[src]), pc.is_valid(pairs[dst])))
        if not pairs.num_rows:
            return
        nodes = pa.chunked_array([*pairs[src].chunks, *pairs[dst].chunks]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(nodes.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        u, v = rank[nodes.indices.to_numpy()].reshape(2, -1)
        known = pc.is_valid(pairs["score"]).to_numpy()
        score = pc.fill_null(pairs["score"], 0.0).to_numpy()
        names = nodes.dictionary.take(pa.array(order))
        totals = np.bincount(u, score, len(order)), np.bincount(u[known], minlength=len(order)).astype(np.int64)
        yield pa.record_batch({"node": names, "low": names.take(pa.array(lowest(u, v, len(order)))), "total": pa.array(totals[0]), "n": pa.array(totals[1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= GATHERED:
                yield from rows(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from rows(pa.Table.from_batches(held))

    return run


def duplicate_groups(pairs: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(root, members, size, avg_score): components of the accepted pairs with the mean of their scores.

    The pairs are read once. Each chunk of them is told as one row per node, so what is shuffled grows with the nodes.
    """
    kind = pairs.schema[src].dataType.simpleString()
    told = pairs.select(src, dst, F.col("score").cast("double").alias("score")).mapInArrow(_gathered(src, dst), f"node {kind}, low {kind}, total double, n long")
    told = staged(told, "told")
    labels = staged(components(told, "node", "low"), "labels")
    sums = told.groupBy("node").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    scores = labels.join(sums, "node").groupBy(F.col("component").alias("root")).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("avg_score"))
    members = labels.groupBy(F.col("component").alias("root")).agg(F.array_sort(F.collect_list("node")).alias("members"))
    return members.join(scores, "root").select("root", "members", F.size("members").cast("long").alias("size"), "avg_score")


def find_duplicates(chunks: DataFrame, threshold: float, keep: Column | None = None, keep_pair: Column | None = None) -> DataFrame:
    """(root, chunks, avg_score, reason) over chunks with point_id, embedding and position; distinct contents only.

    keep filters chunks; keep_pair filters pairs, by the chunks' columns under a and b and by score.
    """
    rows = chunks.where(keep) if keep is not None else chunks
    rows = rows.where(F.col("embedding").isNotNull()).dropDuplicates(["point_id"])
    rows = staged(rows, "candidates")
    # a short chunk makes every pair of it trivial
    long = rows.where(F.col("end_line") - F.col("start_line") + 1 >= 3)
    place = [c for c in rows.columns if c not in ("embedding", "content")] if keep_pair is not None else ["file_path", "start_line", "end_line"]
    found = paired(long, threshold, "point_id", carry=place)
    found = found if keep_pair is None else found.where(keep_pair)
    found = found.where(~trivial()).select(F.col("a.point_id").alias("a"), F.col("b.point_id").alias("b"), "score")
    groups = duplicate_groups(found)
    flat = groups.select("root", "avg_score", F.explode("members").alias("point_id")).join(rows.drop("embedding"), "point_id")
    whole = F.struct(*[c for c in rows.columns if c != "embedding"])
    return flat.groupBy("root").agg(F.array_sort(F.collect_list(whole)).alias("chunks"), F.first("avg_score").alias("avg_score")).withColumn("reason", F.lit(REASON))
