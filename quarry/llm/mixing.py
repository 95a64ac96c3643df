"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Main path: DataFrame functions only. Each source's documents are shuffled by a digest of their id and laid end to
end; the run is cut into blocks of `block_tokens` words. Golden-ratio points, taken modulo 2**31 in exact integers,
pass through the sources' cumulative weights and name a source for every slot. The k-th slot of a source takes its
k-th block, starting over when the blocks are used up. The slots are the order of the mix: `mix_sizes` tells each
document's first slot, and `mix` gives its rows in that order, so that every stretch of it has the sources' shares.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; rows that repeat a
doc_id are separate documents, and those without one are shuffled by their texts; sources without words have target 0;
an empty table gives an empty mix. Extra columns are kept by `mix` and never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.words import first_words, word_count
from quarry.scratch import located, staged

#: Points lie in [0, 2**31); the multiplier is the odd integer next to 2**31 / golden ratio.
MODULUS = 1 << 31
GOLDEN = 1327217885
CELLS = 1024
#: Slots ranked together before the per-source offsets are added.
CHUNK = 8192


def sized(docs: DataFrame, rid: Column | None = None, seed: str = "mix") -> DataFrame:
    """One row per document: rid, doc_id, source, size in words, digest that orders the shuffle, text hash for ties."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))
    return docs.select(
        F.monotonically_increasing_id().alias("rid") if rid is None else rid.alias("rid"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("digest"),
        F.xxhash64(text).alias("tie"),
    )


def targets(rows: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Per source: source_size, weight, target.

    The target is min(limit * size, level * weight), with the level at which all targets add up to share * all
    sizes. Both windows run over one row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    per = per.withColumn("weight", F.element_at(cycle, at)).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (want - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # a source is full if the level, with all sources before it full, still reaches its cap; past the first
    # that is not, levels only fall, so the largest of theirs is the true one
    full = F.col("level") >= F.col("cap") / F.col("weight")
    per = per.withColumn("is_full", full)
    open_level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything)
    return per.select(
        "source",
        "source_size",
        "weight",
        F.round(F.when(F.col("is_full"), F.col("cap")).otherwise(F.least("cap", open_level * F.col("weight"))), 6).alias("target"),
    )


def plan_sources(goal: DataFrame, block_tokens: int) -> DataFrame:
    """Per source with words to take: its blocks, slots, whole passes and interval [lo, hi) of points."""
    size, take = F.col("source_size"), F.col("take")
    per = (
        goal.withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
        .where(take > 0)
        .withColumn("blocks", F.ceil(size / F.lit(block_tokens)).cast("long"))
        .withColumn("passes", F.floor(take / size).cast("long"))
        .withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil((take - F.col("passes") * size) / F.lit(block_tokens))).cast("long"))
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    everything = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    point = lambda x: F.floor(x / everything * F.lit(float(MODULUS))).cast("long")
    per = per.withColumn("all_slots", everything).withColumn("lo", point(upto - F.col("slots"))).withColumn("hi", point(upto))
    return per.withColumn("sid", F.row_number().over(order).cast("long"))


def schedule(per: DataFrame, n_slots: int) -> DataFrame:
    """One row per slot: slot, sid, k (the slot's rank in its source).

    Points and interval starts meet in CELLS equal cells, so the last start at or below a point is found by a
    window in its cell; ranks are counted in chunks of slots and offset by the chunks before.
    """
    width = MODULUS // CELLS
    spark = per.sparkSession
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % F.lit(MODULUS)) * F.lit(GOLDEN) % F.lit(MODULUS)).alias("point")
    )
    starts = (
        per.where("hi > lo")
        .select("sid", "lo", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
        .select(F.lit(None).cast("long").alias("slot"), F.greatest("lo", F.col("cell") * width).alias("point"), "sid")
    )
    both = slots.withColumn("sid", F.lit(None).cast("long")).unionByName(starts)
    both = both.withColumn("cell", F.floor(F.col("point") / width))
    upto = Window.partitionBy("cell").orderBy("point", F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = both.withColumn("sid", F.last("sid", ignorenulls=True).over(upto)).where("slot is not null").select("slot", "sid")
    named = named.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sofar = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(sofar), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("r", rank).join(counts.select("sid", "chunk", "offset"), ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("r") + F.col("offset")).alias("k"))
    ranked = ranked.join(per.select("sid", "slots"), "sid").where("k < slots").select("slot", "sid", "k")
    # a closing run tops up the sources that the finite schedule leaves a few slots short
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = per.select("sid", "slots").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    closing = short.select("sid", "got", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("k")).select(
        (F.lit(n_slots) + F.col("k") - F.col("got")).alias("slot"), "sid", "k"
    )
    return ranked.unionByName(closing)


def placed(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with sid and `start`, the document's first word in its source's shuffled run.

    Running sums go by (source, part of the digest range), then over the parts, so no source meets in one task.
    """
    rows = rows.where("size > 0").join(per.select("source", "sid"), rows["source"].eqNullSafe(per["source"]))
    rows = rows.select("rid", "sid", "size", "digest", "doc_id", "tie", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int").alias("part"))
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "part").orderBy("digest", "doc_id", "size", "tie", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["sid", "part"]).select("rid", "sid", "size", (F.col("offset") + F.col("inside")).alias("start"))


def mix_pieces(
    rows: DataFrame, goal: DataFrame, block_tokens: int = 1024
) -> DataFrame:
    """The mix: slot, at (word in the source's run), rid, pass, first (word of the document), words. In order of (slot, at) it is the stream."""
    per = staged(plan_sources(goal, block_tokens), "mix-plan")
    found = per.agg(F.max("all_slots")).first()[0]
    b = F.lit(block_tokens)
    order = schedule(per, int(found or 0)).join(per.select("sid", "source_size", "take", "blocks", "passes"), "sid")
    order = order.withColumn("pass", F.least(F.floor(F.col("k") / F.col("blocks")), F.col("passes")))
    order = order.withColumn("block", F.col("k") - F.col("pass") * F.col("blocks"))
    at = F.col("block") * b
    upto = F.least(at + b, F.col("source_size"), F.col("take") - F.col("pass") * F.col("source_size"))
    order = order.select("slot", "sid", "pass", "block", upto.alias("upto"))
    docs = placed(rows, per)
    end = F.col("start") + F.col("size")
    pieces = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("block") * b)).withColumn("to", F.least(end, (F.col("block") + 1) * b))
    return (
        pieces.join(order, ["sid", "block"])
        .select("slot", F.col("from").alias("at"), "rid", "pass", (F.col("from") - F.col("start")).alias("first"), (F.least("to", "upto") - F.col("from")).alias("words"))
        .where("words > 0")
    )


def goals(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    return staged(targets(rows, weights, share, limit), "mix-targets")


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_tokens: int = 1024) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_slot (-1 where nothing is taken)."""
    rows = staged(sized(docs), "mix-rows")
    goal = goals(rows, weights, share, limit)
    taken = mix_pieces(rows, goal, block_tokens).groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = rows.select("rid", "doc_id", "source", "size")
    out = rows.join(goal.select("source", "source_size", "target"), rows["source"].eqNullSafe(goal["source"])).join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_tokens: int = 1024) -> DataFrame:
    """The mixed documents, with the columns of docs, in the order of their first slots.

    A document appears once for every pass that takes it. The one document of a source at which its target is
    reached keeps its first words only; documents without words are kept as they are, dealt among the others. The
    order goes over partitions as well: the slots are cut into as many equal ranges as there are shuffle partitions.
    """
    columns = docs.columns
    docs, file, place = located(docs, "mix-docs")
    rid = F.struct(F.xxhash64(file).alias("file"), place.alias("place"))
    rows = staged(sized(docs.select("doc_id", "source", "text", rid.alias("rid")), F.col("rid")), "mix-rows")
    goal = goals(rows, weights, share, limit)
    per_pass = mix_pieces(rows, goal, block_tokens).groupBy("rid", "pass").agg(F.sum("words").alias("words"), F.min(F.struct("slot", "at")).alias("order"))
    none = F.lit(0).cast("long")
    empty = rows.where("size = 0").select("rid", none.alias("pass"), none.alias("words"), F.lit(None).cast(per_pass.schema["order"].dataType).alias("order"))
    takes = per_pass.unionByName(empty).join(rows.select("rid", "size"), "rid")
    takes = staged(takes.select("rid", "words", (F.col("words") < F.col("size")).alias("cut"), "order"), "mix-takes")
    out = docs.select(rid.alias("rid"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).join(takes, "rid")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = takes.agg(F.max("order.slot")).first()[0]
    part = F.floor(F.col("order.slot") * n / F.lit(int(slots or 0) + 1))
    out = out.repartitionById(n, F.coalesce(part, F.pmod(F.xxhash64("rid"), F.lit(n))).cast("int")).sortWithinPartitions(F.col("order").asc_nulls_last(), "rid")
    cut = F.when(F.col("cut"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))

    def column(c: str) -> Column:
        if c == "text":
            return cut.alias(c)
        if c == "n_chars":
            return F.when(F.col("cut"), F.length(cut)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in columns])
