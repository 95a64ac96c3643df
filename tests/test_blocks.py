from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.operators import duplicates, search
from quarry.operators.components import lowest
from quarry.scratch import recorded


def shuffles(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def brute(rows, threshold):
    out = []
    for a, x in rows:
        for b, y in rows:
            if None not in (a, b, x, y) and a < b and len(x) == len(y) and np.any(x) and np.any(y):
                s = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                out += [(a, b, round(s, 9))] if s >= threshold else []
    return sorted(out)


@pytest.mark.parametrize("block", [4, 100])
def test_similar_pairs_copy_no_vector(spark, block):
    rng = np.random.default_rng(3)
    rows = [(f"k{i:02}", rng.normal(size=rng.choice([2, 3])).tolist()) for i in range(30)] + [("z", [0.0, 0.0]), ("n", None), ("e", []), (None, [1.0, 1.0]), ("k03", [1.0, 0.5])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    got = duplicates.similar_pairs(df, 0.0, block=block)
    assert not shuffles(got)
    single = [(k, v and np.float32(v).astype(float).tolist()) for k, v in rows]
    assert sorted((a, b, round(s, 9)) for a, b, s in got.collect()) == brute(single, 0.0)
    assert duplicates.similar_pairs(df.where(F.lit(False)), 0.0, block=block).count() == 0


def test_lowest_node_of_random_graphs():
    rng = np.random.default_rng(5)
    for n, m in [(1, 0), (1, 1), (40, 25), (40, 200), (300, 280)]:
        u, v = rng.integers(0, n, (2, m))
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(u, v, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert lowest(u, v, n).tolist() == want.tolist()
    assert set(lowest(np.arange(1, 5000), np.arange(4999), 5000)) == {0}


def test_chunks_of_pairs_are_told_by_node(monkeypatch):
    monkeypatch.setattr(duplicates, "GATHERED", 3)
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip("ab", r[:2], strict=True), score=r[2]) for r in rows])
    batches = [batch(("d", "c", 0.5), ("c", "b", 0.25)), batch(("d", "x", None), ("y", None, 9.0)), batch(("x", "z", 1.0))]
    got = [b.to_pylist() for b in duplicates._gathered("a", "b")(iter(batches))]
    shown = [sorted((r["node"], r["low"], r["total"], r["n"]) for r in rows) for rows in got]
    assert shown == [[("b", "b", 0.0, 0), ("c", "b", 0.25, 1), ("d", "b", 0.5, 1), ("x", "b", 0.0, 0)], [("x", "x", 1.0, 1), ("z", "x", 0.0, 0)]]


def test_groups_read_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (8, 9, 1.0)], "a long, b long, score double")
    got = duplicates.duplicate_groups(pairs.mapInArrow(counted, pairs.schema)).collect()
    assert sorted((r["root"], r["members"], r["size"], round(r["avg_score"], 9)) for r in got) == [(1, [1, 2, 3], 3, 0.6), (8, [8, 9], 2, 1.0)]
    assert seen.value == 3


def test_trivial_pairs_are_judged_without_a_shuffle(spark, small):
    assert not shuffles(catalogue.QUERIES["trivial_pairs"](spark, small))


def test_find_duplicates_stages_neither_texts_nor_joined_pairs(spark, small):
    with recorded() as paths:
        catalogue.QUERIES["find_duplicates"](spark, small)
    names = {p.rsplit("/", 1)[1].rsplit("-", 5)[0]: spark.read.parquet(p).columns for p in paths if isinstance(p, str) and "-blocks-" not in p}
    assert "candidates" in names and "pairs" not in names
    assert not any("content" in columns for columns in names.values())


def test_pair_filter_sees_all_columns(spark):
    row = lambda i, lines, v, tags: (i, f"f{i}", 1, lines, "text", v, tags, datetime(2024, 1, 1 + i))
    rows = [row(1, 9, [1.0, 0.0], ["x"]), row(2, 9, [1.0, 0.1], None), row(3, 9, [1.0, 0.2], ["x", "y"]), row(4, 2, [1.0, 0.0], ["x"]), row(5, 9, [1.0, 0.0], [])]
    kinds = "point_id long, file_path string, start_line long, end_line long, content string, embedding array<double>, tags array<string>, at timestamp"
    chunks = spark.createDataFrame(rows, kinds)
    keep = F.array_contains("a.tags", "x") & (F.col("b.at") < F.lit(datetime(2024, 1, 5))) & (F.col("score") < 0.99)
    got = duplicates.find_duplicates(chunks, 0.5, keep_pair=keep).collect()
    assert [[c["point_id"] for c in r["chunks"]] for r in got] == [[1, 3]] and got[0]["chunks"][0]["content"] == "text"


def test_similarities_copy_no_vector(spark):
    chunks = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, embedding array<double>")
    queries = chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = search.similarities_block(chunks, queries, "id", rows=2, asked=4)
    assert not shuffles(got) and got.count() == 81
