"""Connected components of an edge table, by alternating large-star and small-star contraction.

Only edge-sized tables are joined; each round is a written table, so lineage stays short and a lost executor costs one
round at most. Minima are taken with partial aggregation and written before they are joined back, so that the join
reads two plain exchanges and adaptive execution can split a hub's neighbours over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import staged

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    low = staged(low.select("u", F.least("low", "u").alias("low")), "lows")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = staged(edges.groupBy("u").agg(F.min("v").alias("low")), "lows")
    moved = edges.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node reachable. Null endpoints are dropped."""
    u, v = F.col(src), F.col(dst)
    start = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull())
    loops = start.where("u = v").select("u").distinct()
    start = start.where("u != v").select("u", "v").distinct()
    now = staged(start, "edges")
    loops = staged(loops, "loops")
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = staged(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = leaves.unionByName(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(known.select("node"), "node", "left_anti")
    return known.unionByName(alone)


def lowest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes 0 to n - 1 the smallest one that each reaches over the edges u to v, in memory."""
    low = np.arange(n)
    while len(u):
        one, two = low[u], low[v]
        apart = one != two
        # a root hangs below the smallest root that it meets, then all nodes move up to their roots
        u, v, one, two = u[apart], v[apart], one[apart], two[apart]
        np.minimum.at(low, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(up := low[low], low):
            low = up
    return low
