"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Equal shingle sets are one class, so copies never meet in pairs. Class representatives are sketched with `coords`
coordinates in bands of `rows`; at the threshold of 0.8 a pair shares no band of 32 with probability 5e-8. Members of
a band bucket are first checked against its most central member, the one in the fullest buckets. Of buckets that then
still hold several components, small ones are paired in full; in large ones the members outside the largest component
are checked against it, and against each other, in blocks of whole sets. Members that are already connected need no
check, so no link that could change a component is skipped, and there is no cap. Every member is first checked against
the one central member it shares most bands with. Texts are read twice and never shuffled; sets are, of candidates only.

Defined results: null, empty or blank texts have no shingles and link with nothing; a text with fewer words than the
shingle width is one shingle; a null doc_id is kept and is the group's id only if no other member has one; repeated
rows share a class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.llm.filters import bitmap_bytes, marked, passing, slots
from quarry.llm.shingles import shingle_sets
from quarry.llm.sketch import band_keys, sketches
from quarry.operators.components import components
from quarry.scratch import shared, staged

#: Buckets of at most so many members are paired in full.
SMALL = 32
#: Sets checked against as many others in one go.
BLOCK = 128


def set_hashes(items: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set."""
    out = []
    for seed in (51, 52):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mixed(items, seed))])
            out.append(B.mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64), seed).view(np.int64))
    return out[0], out[1]


def _sketcher(width: int, coords: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                items, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                h1, h2 = set_hashes(items, at)
                keys = band_keys(sketches(items, at, coords), rows).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("id"), part.column("key"), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), bands],
                    names=["rid", "id", "key", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _setter(width: int, wanted, bits: int):
    """Sets of the texts whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passing(wanted.value, batch.column("hash").to_numpy(), bits)))
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                items, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                h1, h2 = set_hashes(items, at)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), sets], names=["h1", "h2", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("union"))
    return both.where(F.col("shared") * 100 >= F.col("union") * threshold).select("a", "b")


def _in_size(a: str, b: str, threshold: int):
    """Sets whose sizes alone rule the threshold out are not paired."""
    return (F.col(a) * 100 >= F.col(b) * threshold) & (F.col(b) * 100 >= F.col(a) * threshold)


def near_classes(
    docs: DataFrame, key: str = "doc_id", width: int = 2, threshold: int = 80, coords: int = 128, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, key, n_shingles, h1, h2) and classes (h1, h2, first_rid, first_id, component).

    key names a column that finds a document again in a second scan; component is the smallest class node reachable.
    """
    spark = docs.sparkSession
    scan = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("id"),
        F.col(key).cast("string").alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    kind = "rid long, id long, key string, n_shingles long, h1 long, h2 long, bands array<long>"
    found = staged(scan.mapInArrow(_sketcher(width, coords, rows), kind), "near-rows")
    classes = found.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("rid").alias("node"), F.min("id").alias("first_id"), F.min("n_shingles").alias("n"), F.min_by(F.struct("bands", "key"), "rid").alias("of")
    )
    classes = staged(classes.select("h1", "h2", "node", "first_id", "n", "of.bands", "of.key"), "near-classes")
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    # small sides are written before they are joined, so that adaptive execution can split a hot key of the large side
    full = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-bands")
    hits = staged(members.join(full, "band").select("band", "node", "n", "c"), "near-hits")
    central = hits.groupBy("node").agg(F.sum("c").alias("reach"))
    pivots = hits.join(central, "node").groupBy("band").agg(F.max(F.struct("reach", (-F.col("node")).alias("first"), "n")).alias("p"))
    pivots = staged(pivots.select("band", (-F.col("p.first")).alias("a"), F.col("p.n").alias("na")), "near-pivots")
    star = hits.select("band", "node", "n").join(pivots, "band")
    star = star.where("node != a").where(_in_size("na", "n", threshold)).groupBy("node", "a").agg(F.count(F.lit(1)).alias("bands"))
    star = star.groupBy("node").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
    star = staged(star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "near-pairs")

    wanted = hits.select("node").distinct().join(classes.select("node", "h1", "h2", "key"), "node")
    wanted = staged(wanted, "near-wanted")
    # a text that passes by chance finds no partner in the join; slots() bounds the filter
    bits = slots(wanted.count())
    sent = shared(spark, bitmap_bytes(wanted.select(F.xxhash64("key").alias("hash")), "hash", bits))
    texts = docs.select(F.xxhash64(F.col(key).cast("string")).alias("hash"), F.col("text").cast("string").alias("text"))
    sets = texts.mapInArrow(_setter(width, sent, bits), "h1 long, h2 long, items array<long>").join(wanted.select("h1", "h2", "node"), ["h1", "h2"])
    sets = staged(sets.dropDuplicates(["node"]), "near-sets")

    links = staged(_verified(star, sets, threshold), "near-links")
    labels = staged(components(links, "a", "b"), "near-labels")
    open_hits = _named(hits, labels).join(_open_buckets(hits, labels), "band").select("band", "node", "n", "c", "component")
    open_hits = staged(open_hits, "near-open")
    more = _verified(_small_pairs(open_hits.where(F.col("c") <= SMALL), threshold), sets, threshold)
    more = more.unionByName(_block_links(open_hits.where(F.col("c") > SMALL), labels, sets, threshold))
    links = links.unionByName(staged(more, "near-links"))
    labels = staged(components(links, "a", "b"), "near-labels")
    out = classes.select("h1", "h2", "node", "first_id").join(labels, "node", "left")
    out = out.withColumn("component", F.coalesce("component", "node"))
    smallest = out.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return found.drop("bands"), out.join(smallest, "component").select("h1", "h2", "node", "component", "component_id")


def _named(hits: DataFrame, labels: DataFrame) -> DataFrame:
    return hits.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_buckets(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that hold members of several components."""
    found = _named(hits, labels).groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band")
    return staged(found, "near-open-bands")


def _small_pairs(hits: DataFrame, threshold: int) -> DataFrame:
    """All pairs across components in buckets of bounded size."""
    left = hits.select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    pairs = left.join(hits, "band").where("a < node and ca != component").where(_in_size("na", "n", threshold))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def _block_links(hits: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of the members outside a large bucket's largest component, to that component and among each other.

    Both sides are dealt into blocks of whole sets; in a block, a member gives one link to each other component.
    """
    counts = hits.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    main = staged(counts.groupBy("band").agg(F.max(F.struct("k", "component")).alias("main")).select("band", F.col("main.component").alias("main")), "near-main")
    others = hits.join(main, "band").where("component != main").select("main", "node", "component").distinct()
    others = staged(others, "near-others")
    labelled = labels.select("node", F.col("component").alias("main"))
    # a component of one has no label of its own
    alone = others.select("main").distinct().join(labelled.select("main").distinct(), "main", "left_anti").select(F.col("main").alias("node"), "main")
    inside = labelled.join(others.select("main").distinct(), "main", "left_semi").select("node", "main").unionByName(alone)
    every = inside.withColumn("component", F.col("main")).unionByName(others.select("node", "main", "component"))
    blocks = lambda df, name: df.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
    sizes = staged(blocks(every, "xs").join(blocks(others, "ys"), "main"), "near-blocks")
    part = lambda df, salt, n: df.withColumn("part", F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int"))
    x = part(every.join(sizes, "main"), "x", "xs").select("node", "main", "component", F.col("part").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("yb"), F.lit(False).alias("asks"))
    y = part(others.join(sizes, "main"), "y", "ys").select("node", "main", "component", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.col("part").alias("yb"), F.lit(True).alias("asks"))
    dealt = x.unionByName(y).join(sets, "node")
    return dealt.groupBy("main", "xb", "yb").applyInArrow(_block_checker(threshold), "a long, b long").distinct()


def _block_checker(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        nodes, groups = (table.column(c).combine_chunks().to_numpy() for c in ("node", "component"))
        lists = table.column("items").combine_chunks()
        at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        size = np.diff(at)
        index = np.flatnonzero(~asks)
        a, b = [], []
        if len(index) and asks.any():
            owner = np.repeat(np.arange(len(index)), size[index])
            items = np.concatenate([flat[at[k] : at[k + 1]] for k in index])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            for k in np.flatnonzero(asks):
                own = flat[at[k] : at[k + 1]]
                lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
                run_of = hi - lo
                places = np.repeat(lo - np.concatenate([[0], np.cumsum(run_of)[:-1]]), run_of) + np.arange(run_of.sum())
                shared = np.bincount(owner[places], minlength=len(index))
                union = size[k] + size[index] - shared
                hit = index[(shared * 100 >= union * threshold) & (groups[index] != groups[k])]
                for j in hit[np.unique(groups[hit], return_index=True)[1]]:
                    a.append(min(nodes[k], nodes[j]))
                    b.append(max(nodes[k], nodes[j]))
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run


def near_groups(docs: DataFrame, key: str = "doc_id", width: int = 2, threshold: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id is the component's smallest)."""
    rows, classes = near_classes(docs, key, width, threshold)
    # rows without shingles have one key, and are in no class
    none = rows.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    some = rows.where("n_shingles > 0").join(staged(classes, "near-ids"), ["h1", "h2"])
    out = some.select("id", "n_shingles", "component_id").unionByName(none.select("id", "n_shingles", "component_id"))
    group = F.col("component_id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", group.alias("component_id"), group.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """docs without the documents whose group has an earlier one; of equal ids the first row stays.

    A digest of id and text finds the rows again. Only texts that may go are shuffled, all others pass a filter.
    """
    columns = docs.columns
    doc_id, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    digest = F.md5(F.concat(F.coalesce(doc_id, F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))
    rows, classes = near_classes(docs.select("doc_id", "text", digest.alias("key")), "key", width, threshold)
    grouped = rows.where("n_shingles > 0").join(staged(classes, "near-ids"), ["h1", "h2"]).select("component", "rid", "id", "key")
    grouped = staged(grouped, "near-grouped")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    first = grouped.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = staged(first, "near-first")
    # a group's rows with the first one's digest are the same document again
    found = grouped.join(first.select("component", F.col("first.rid").alias("first")), "component")
    fate = found.groupBy("key").agg(F.max(F.col("rid") == F.col("first")).alias("once"), F.count(F.lit(1)).alias("n")).where("not once or n > 1").select("key", "once")
    fate = staged(fate, "near-fate")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    told = marked(docs.select(row.alias("row"), digest.alias("key")), fate.select("key"), "key")
    again = told.where("may").select("row", "key").join(fate, "key", "left")
    kept = told.where("not may").select("row").unionByName(again.where("once is null").select("row"))
    kept = kept.unionByName(again.where("once").dropDuplicates(["key"]).select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
