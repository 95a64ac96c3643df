from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.functions.vectors import cosine, raw_similarity
from quarry.operators import duplicates, search, snapshots
from quarry.operators.components import components


def groups_of(spark, edges):
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    return {r["node"]: r["component"] for r in got}


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([], {}),
        ([(1, 2)], {1: 1, 2: 1}),
        ([(5, 4), (4, 3), (3, 2), (2, 1)], dict.fromkeys(range(1, 6), 1)),
        ([(9, k) for k in range(1, 9)], dict.fromkeys(range(1, 10), 1)),
        ([(1, 2), (2, 3), (3, 1), (7, 8), (7, 8)], {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}),
        ([(4, 4), (1, None)], {4: 4}),
    ],
)
def test_components(spark, edges, want):
    assert groups_of(spark, edges) == want


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert groups_of(spark, edges) == {x: find(x) for e in edges for x in e}


def test_vector_edge_cases(spark):
    rows = [(1, [3.0, 4.0], [3.0, 4.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 2.0]), (4, None, [1.0]), (5, [2.0, 0.0], [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", cosine(F.col("a"), F.col("b")), raw_similarity(F.col("a"), F.col("b"))).collect()}
    assert got[1] == (pytest.approx(1.0), pytest.approx(25 / 625))
    assert got[2] == got[3] == got[4] == (0.0, 0.0) and got[5] == (0.0, 0.0)


def test_similar_pairs_in_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, [0.0] * 6), (61, None), (62, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(r["a"], r["b"]): r["score"] for r in duplicates.similar_pairs(df, 0.5, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    want = {(i, j): s[i, j] for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def two_passes(hits, k):
    ordered = sorted(hits, key=lambda h: (-h[2], h[0]))
    first, seen = [], set()
    for h in ordered:
        if h[1] not in seen and len(first) < k:
            seen.add(h[1])
            first.append(h)
    rest = [h for h in ordered if h not in first]
    return (first + rest)[: max(k, 0)]


@pytest.mark.parametrize("k", [-1, 0, 1, 3, 7, 50])
def test_diverse(spark, k):
    rng = random.Random(k)
    hits = [(i, f"f{rng.randrange(5)}", rng.randrange(4) / 4) for i in range(20)]
    df = spark.createDataFrame(hits, "id long, file string, score double")
    assert [tuple(r) for r in search.diverse(df, k, "file", ["id"]).collect()] == two_passes(hits, k)


@pytest.mark.parametrize("k", [0, 1, 3, 9, 40])
def test_block_search_equals_single_queries(spark, k):
    rng = random.Random(k)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(rng.choice([3, 3, 3, 4]))] for _ in range(36)] + [[0.0] * 3, None]
    rows = [(i, f"f{rng.randrange(6)}", v) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "id long, file string, embedding array<double>")
    asked = [0, 5, 10, 36]
    queries = spark.createDataFrame([(i, vectors[i]) for i in asked] + [(99, None)], "query_id long, query_vector array<double>")
    top, wide = (f(chunks, queries, k, *key, ["id"], rows=10, asked=2).orderBy("query_id", "place").collect() for f, key in [(search.topk_block, []), (search.spread_block, ["file"])])
    want_top, want_wide = [], []
    for i in asked:
        want_top += [(i, n, r["id"], r["score"]) for n, r in enumerate(search.topk(chunks, vectors[i], k, ["id"]).collect(), 1)]
        hits = [tuple(r) for r in search.scored(chunks, vectors[i]).select("id", "file", "score").collect()]
        want_wide += [(i, n, r[0], r[2]) for n, r in enumerate(two_passes(hits, k), 1)]
    shown = lambda found: [(r["query_id"], r["place"], r["id"], r["score"]) for r in found]
    assert shown(top) == want_top and shown(wide) == want_wide


def test_similarities_in_blocks_equal_expressions(spark):
    vectors = [[3.0, 4.0], [0.0, 0.0], [1.0], None, [-1.0, 2.0], [], [2.0, 0.5]]
    chunks = spark.createDataFrame(list(enumerate(vectors)) + [(0, [3.0, 4.0])], "id long, embedding array<double>")
    queries = chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")).where("id <> 4")
    got = search.similarities_block(chunks, queries, "id", rows=3, asked=2)
    both = chunks.crossJoin(queries)
    want = both.select("query_id", "id", cosine(F.col("embedding"), F.col("query_vector")), raw_similarity(F.col("embedding"), F.col("query_vector")))
    shown = lambda df: sorted((r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in df.collect())
    assert shown(got) == shown(want) and got.count() == 8 * 7
    assert search.similarities_block(chunks.limit(0), queries, "id").count() == search.similarities_block(chunks, queries.limit(0), "id").count() == 0


def test_search_finds_live_hits_behind_gone_and_hot_files(spark):
    gone = [(f"gone{i}", 1, 2, "g", [1.0, 0.0]) for i in range(40)] + [(None, 1, 2, "n", [1.0, 0.0])] * 40
    hot = [("hot", i, i, "h", [1.0, 0.1]) for i in range(40)]
    rest = [(f"live{i}", 1, 2, "l", [1.0, 1.0 + i]) for i in range(3)]
    chunks = spark.createDataFrame(gone + hot + rest, "file_path string, start_line long, end_line long, content string, embedding array<double>")
    live = spark.createDataFrame([("hot",), ("live0",), ("live1",), ("live2",)], "file_path string")
    found = [(r["file_path"], r["start_line"]) for r in search.search(chunks, [1.0, 0.0], 5, live).collect()]
    assert found == [("hot", 0), ("live0", 1), ("live1", 1), ("live2", 1), ("hot", 1)]
    assert search.search(chunks, [1.0, 0.0], 2, live).count() == 2 and search.search(chunks, [1.0, 0.0], 0, live).count() == 0


def test_search_takes_names_of_one_file_as_one(spark):
    kinds = "file_path string, start_line long, end_line long, content string, embedding array<double>"
    rows = [("/r/a", 1, 2, "x", [1.0, 0.0]), ("a", 3, 4, "x", [1.0, 0.01]), ("./b/../a", 5, 6, "x", [1.0, 0.02]), ("/r/b", 1, 2, "y", [1.0, 1.0]), ("/c", 1, 2, "z", [1.0, 0.0])]
    live = spark.createDataFrame([("/r/a",), ("/r/b",)], "file_path string")
    found = search.search(spark.createDataFrame(rows, kinds), [1.0, 0.0], 3, live, "/r").collect()
    assert [(r["file_path"], r["start_line"]) for r in found] == [("a", 1), ("b", 1), ("a", 3)]


def test_snapshots_of_empty_tables(spark):
    none = spark.createDataFrame([], "file_path string, file_hash string")
    some = spark.createDataFrame([("a", "1"), ("b", "2")], "file_path string, file_hash string")
    assert {tuple(r) for r in snapshots.diff(none, some).collect()} == {("a", "added"), ("b", "added")}
    assert {tuple(r) for r in snapshots.diff(some, none).collect()} == {("a", "deleted"), ("b", "deleted")}
    assert snapshots.changed(some, some).count() == 0 and snapshots.deleted(some, none).count() == 2


def test_upsert_last_wins(spark):
    kinds = "k string, v int"
    got = snapshots.upsert(spark.createDataFrame([("a", 1), ("b", 2)], kinds).coalesce(1), spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], kinds).coalesce(1), ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 4), ("c", 5)}


@pytest.mark.parametrize(
    ("path", "pattern", "hit"),
    [
        ("build/a.py", "build/", True), ("x/build/a.py", "build/", False), ("a.md", "*.md", True), ("x/a.md", "*.md", False), ("x/tmp/a.py", "tmp", True),
        ("x/tmpa.py", "tmp", False), ("lead", "/lead", False), ("!keep", "!keep", True), ("a1.py", "a[0-9].py", True), ("ab.py", "a[^0-9].py", True), ("a/b/c", "a/**", False),
    ],
)
def test_ignore_patterns(path, pattern, hit):
    assert paths.ignored(path, [pattern]) is hit


def test_ignore_file_lines():
    assert paths.ignore_lines("# a\n\n  b/ \n!c\n") == ["b/", "!c"]


def test_skipped_dirs():
    assert not paths.skipped_dir(".", []) and paths.skipped_dir("a/node_modules", []) and paths.skipped_dir("gen", ["gen/"]) and not paths.skipped_dir("src", [])


@given(st.text(alphabet="ab*?[]/.", min_size=1, max_size=8), st.text(alphabet="ab/.", min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_glob_never_breaks(pattern, path):
    paths.ignored(path, [pattern])
