"""Removing every byte that lies in a string of `length` bytes occurring twice or more.

Bucket-pointer refinement, over the places that can matter. Anchors (see that module) stand for the windows that own
them, and equal windows have anchors with equal q-grams at equal offsets, so a window is only ever compared inside the
bucket of its anchor's q-gram. Buckets of one are final. Anchors whose windows span equal bytes are settled together,
by a 128-bit digest of those bytes, as copies of a whole document are by SHA-256. What is left, one byte string for
each different span of a bucket, goes bucket by bucket to tasks that refine the positions in it (see refinement), on
the bytes themselves. Buckets of more than HOT bytes are first dealt over the cluster: their windows form blocks of
BLOCK, named by the bytes that a block's windows share and by the bytes on either side, equal blocks count as one, and
only blocks with the same core are opened into windows.

Texts are never shuffled but for those that lose some bytes, once.

Defined results: a null text is empty; a text shorter than `length` keeps everything; repeated rows are copies of one
another; rows without a doc_id are documents; an empty table gives no rows; extra columns are ignored. Texts of any
length are read in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import anchors as A
from quarry.llm import bytes as B
from quarry.llm.filters import bitmap_bytes, marked, passing, slots
from quarry.llm.refinement import repeated_windows
from quarry.scratch import shared, staged

#: Windows of an anchor that are named together in a hot bucket.
BLOCK = 16
#: Bytes of strings beyond which a bucket is hot, and bytes of buckets that are refined together.
HOT = 1 << 20
TOGETHER = 1 << 19
_WHOLE = "gram long, wa long, wb long"


def _lists(rows: np.ndarray, n: int, columns: list[np.ndarray], kind: list[pa.DataType]) -> list[pa.Array]:
    """List columns of n rows from flat values sorted by row."""
    at = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x, type=k)) for x, k in zip(columns, kind, strict=True)]


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(strings, 2) halves of 128-bit digests of raw[start:end]."""
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _owned(buf: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, gram, first byte of the first window, of the last one, anchor) of every anchor, by bytes of buf."""
    for i, _, a, b, at in A.segments(offsets, length):
        total = A.prefix_hash(buf[a:b])
        starts, own, grams = A.owners(total, at, length, q)
        if len(starts):
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            last = np.append(first[1:], len(starts)) - 1
            x = own[first]
            yield np.searchsorted(at, x, side="right") - 1 + i, grams[x].view(np.int64), starts[first] + a, starts[last] + a, x + a


def _anchorer(length: int, q: int):
    """Rows with their anchors: gram, digest of the span, first window's byte, windows less one, anchor's place in the span."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            raw = buf.tobytes()
            found = []
            for row, gram, lo, hi, x in _owned(buf, offsets, length, q):
                whole = _digests(raw, lo, hi + length)
                found.append((row, gram, whole[:, 0], whole[:, 1], lo - offsets[row], hi - lo, x - lo))
            flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(7)]
            n = len(offsets) - 1
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(sha, type=pa.string()), *_lists(flat[0], n, flat[1:], kinds)],
                names=["id", "n_bytes", "sha", "gram", "wa", "wb", "lo", "w", "d"],
            )

    return run


def _stringer(length: int, q: int, wanted, bits: int):
    """(gram, wa, wb, bytes) of the anchors whose digest's first half may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            raw = buf.tobytes()
            for _, gram, lo, hi, _ in _owned(buf, offsets, length, q):
                may = passing(wanted.value[0], gram, bits[0])
                gram, lo, hi = gram[may], lo[may], hi[may]
                whole = _digests(raw, lo, hi + length)
                may = passing(wanted.value[1], whole[:, 0], bits[1])
                texts = [raw[a:b] for a, b in zip(lo[may].tolist(), (hi[may] + length).tolist(), strict=True)]
                columns = [pa.array(gram[may]), pa.array(np.ascontiguousarray(whole[may, 0])), pa.array(np.ascontiguousarray(whole[may, 1])), pa.array(texts, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "wa", "wb", "string"])

    return run


def _ranges(hit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of hits within one owner."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at


def _refine(table: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(rid, lo, w): runs of windows that occur twice among the strings of whole buckets."""
    buf, at = B.values(table.column("string"))
    n = table.column("w").to_numpy().astype(np.int64) + 1
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    first, last = _ranges(repeated_windows(buf, at[own] + place, length), own)
    rid, lo = table.column("rid").to_numpy()[own[first]], table.column("lo").to_numpy()[own[first]] + place[first]
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(lo.astype(np.int32)), pa.array((last - first).astype(np.int32))], names=["rid", "lo", "w"])


def _refiner(length: int, together: int):
    """_refine over rows sorted by gram, some buckets at a time; no bucket is parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("string").nbytes
            if size < together:
                continue
            table = pa.concat_batches(held)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield _refine(table.slice(0, cut), length)
                table = table.slice(cut)
            held, size = [table], table.column("string").nbytes
        if held:
            yield _refine(pa.concat_batches(held), length)

    return run


def _bytes_at(raw: np.ndarray, index: np.ndarray, used: np.ndarray) -> np.ndarray:
    got = raw[np.clip(index, 0, len(raw) - 1)]
    got[~used] = 0
    return got


def _blocker(length: int):
    """Blocks of the windows of strings: rid, gram, s0 (least distance to the anchor), p, core, sides, mask.

    Bit t of the mask stands for the window of the text that starts at p - t.
    """
    side = BLOCK - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = B.values(batch.column("string"))
            raw = buf.tobytes()
            w, d, lo = (batch.column(c).to_numpy().astype(np.int64) for c in ("w", "d", "lo"))
            most, least = d, d - w
            first, count = least // BLOCK, most // BLOCK - least // BLOCK + 1
            own = np.repeat(np.arange(len(w)), count)
            s0 = (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]) * BLOCK
            tmin, tmax = np.maximum(least[own] - s0, 0), np.minimum(most[own] - s0, side)
            p = at[own] + d[own] - s0
            core = _digests(raw, p, p - side + length)
            steps = np.arange(side)
            left = _bytes_at(buf, p[:, None] - side + steps, steps >= (side - tmax)[:, None])
            right = _bytes_at(buf, (p + length - side)[:, None] + steps, steps < (side - tmin)[:, None])
            mask = (np.int64(1) << (tmax + 1)) - (np.int64(1) << tmin)
            n = len(own)
            fixed = pa.array(np.arange(n + 1, dtype=np.int32) * side)
            sides = [pa.Array.from_buffers(pa.binary(), n, [None, fixed.buffers()[1], pa.py_buffer(np.ascontiguousarray(y).tobytes())]) for y in (left, right)]
            rid, gram = (pa.array(batch.column(c).to_numpy()[own]) for c in ("rid", "gram"))
            halves = [pa.array(np.ascontiguousarray(core[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [rid, gram, pa.array(s0.astype(np.int32)), pa.array((p - at[own] + lo[own]).astype(np.int32)), *halves, *sides, pa.array(mask.astype(np.int32))],
                names=["rid", "gram", "s0", "p", "ca", "cb", "left", "right", "mask"],
            )

    return run


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of a union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _whole_chars(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters that it cuts."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _cutter(length: int, texts: bool):
    """texts: the text without the spans, whole characters only, instead of what repeated() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            (lo, at), (w, _) = ((np.asarray(batch.column(c).values).astype(np.int64), np.asarray(batch.column(c).offsets)) for c in ("lo", "w"))
            spans: list[list[np.ndarray]] = [[], []]
            ends, sha, removed, cut = [0], [], [], []
            for k in range(batch.num_rows):
                own = slice(at[k], at[k + 1])
                a, b = covered(lo[own], lo[own] + w[own] + length)
                raw = buf[offsets[k] : offsets[k + 1]].tobytes()
                edges = np.stack([a, b], axis=1).tolist()
                if texts:
                    edges = [_whole_chars(raw, s, e) for s, e in edges]
                flat = [0, *(x for pair in edges for x in pair), len(raw)]
                rest = b"".join(raw[s:e] for s, e in zip(flat[::2], flat[1::2], strict=True))
                if texts:
                    cut.append(rest.decode())
                    continue
                sha.append(hashlib.sha256(rest).hexdigest())
                spans[0].append(a)
                spans[1].append(b)
                ends.append(ends[-1] + len(a))
                removed.append(int((b - a).sum()))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, type=pa.string())], names=["row", "cut"])
                continue
            lists = [pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.concatenate(y) if y else np.zeros(0, np.int64), type=pa.int64())) for y in spans]
            yield pa.RecordBatch.from_arrays([batch.column("sha"), *lists, pa.array(removed, type=pa.int64()), pa.array(sha, type=pa.string())], names=["sha", "starts", "ends", "n_removed", "kept_sha256"])

    return run


def _refined_blocks(blocks: DataFrame) -> DataFrame:
    """(rid, lo, w): the windows of every block that occur elsewhere."""
    core = ["gram", "s0", "ca", "cb"]
    what = [*core, "left", "right", "mask"]
    kinds = staged(blocks.groupBy(*what).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()), "repeat-kinds")
    common = kinds.groupBy(*core).agg(F.sum("n").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select(*core)
    open_kinds = kinds.join(staged(common, "repeat-cores"), core)
    t = F.col("t")
    windows = open_kinds.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where(F.expr("(mask >> t) & 1 = 1"))
    windows = windows.select(
        "kind", "n", *core, "t", F.substring("left", F.lit(BLOCK) - t, t).alias("before"), F.substring("right", F.lit(1), F.lit(BLOCK - 1) - t).alias("after")
    )
    key = [*core, "t", "before", "after"]
    twice = windows.groupBy(*key).agg(F.sum("n").alias("m")).where("m > 1").select(*key)
    single = windows.where("n = 1").join(twice, key).groupBy("kind").agg(F.bit_or(F.expr("shiftleft(1, t)")).alias("found"))
    known = kinds.where("n > 1").select("kind", F.col("mask").alias("found")).unionByName(single)
    known = staged(kinds.join(known, "kind").select(*what, "found"), "repeat-known")
    bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda x: F.getbit("found", x) == 1)
    found = blocks.join(known, what).select("rid", "p", F.explode(bits).alias("t"))
    return found.select("rid", (F.col("p") - F.col("t")).cast("int").alias("lo"), F.lit(0).alias("w"))


class _Found:
    """Tables of one search: rows (rid, id, n_bytes, sha, anchors), classes (sha, rep, copies, n_bytes), marks (sha, lo, w)."""

    def __init__(self, docs: DataFrame, length: int):
        q = length // 2
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        scan = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
        kind = "id long, n_bytes long, sha string, gram array<long>, wa array<long>, wb array<long>, lo array<int>, w array<int>, d array<int>"
        self.rows = rows = staged(scan.mapInArrow(_anchorer(length, q), kind).withColumn("rid", F.monotonically_increasing_id()), "repeat-rows")
        classes = rows.groupBy("sha").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n_bytes").alias("n_bytes"))
        self.classes = classes = staged(classes.withColumn("all_goes", (F.col("copies") > 1) & (F.col("n_bytes") >= length)), "repeat-classes")
        # one copy of a text stands for all; only rows that may be another one are looked up
        copies = rows.select("rid", "sha").join(classes.where("copies > 1").select("sha", "rep"), "sha").where("rid != rep").select("rid")
        copies = staged(copies, "repeat-copies")
        lists = ["gram", "wa", "wb", "lo", "w", "d"]
        told = marked(rows.where(F.size("gram") > 0).select("rid", *lists), copies, "rid")
        reps = told.where("not may").drop("may").unionByName(told.where("may").drop("may").join(copies, "rid", "left_anti"))
        one = reps.select("rid", F.explode(F.arrays_zip(*lists)).alias("a")).select("rid", "a.*")
        common = staged(one.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"), "repeat-grams")
        anchors = marked(one, common, "gram").where("may").drop("may").join(common, "gram")
        anchors = staged(anchors, "repeat-anchors")
        wholes = anchors.groupBy("gram", "wa", "wb").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "lo", "w", "d")).alias("first"))
        wholes = staged(wholes, "repeat-wholes")
        settled = anchors.join(wholes.where("m > 1").select("gram", "wa", "wb"), ["gram", "wa", "wb"]).select("rid", "lo", "w")
        buckets = wholes.groupBy("gram").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("k"), F.sum(F.col("first.w") + length).alias("size"))
        buckets = staged(buckets.where("least = 1 and k > 1").select("gram", (F.col("size") > HOT).alias("hot")), "repeat-buckets")
        left = staged(wholes.join(buckets, "gram").select("gram", "wa", "wb", "first.*", "hot"), "repeat-open")
        refined = self._refined(scan.select("text"), left, buckets, length, q)
        marks = settled.unionByName(refined).groupBy("rid").agg(F.collect_list(F.struct("lo", "w")).alias("s"))
        marks = marks.select("rid", F.col("s.lo").alias("lo"), F.col("s.w").alias("w"))
        #: texts that lose some bytes; those that go as a whole are told by their class
        self.marks = staged(classes.where("not all_goes").select("sha", F.col("rep").alias("rid")).join(marks, "rid").drop("rid"), "repeat-marks")

    @staticmethod
    def _refined(texts: DataFrame, left: DataFrame, buckets: DataFrame, length: int, q: int) -> DataFrame:
        spark = texts.sparkSession
        none = spark.createDataFrame([], "rid long, lo int, w int")
        n = left.count()
        if not n:
            return none
        bits = slots(n)
        # slots() bounds both filters
        wanted = shared(spark, (bitmap_bytes(buckets, "gram", bits), bitmap_bytes(left, "wa", bits)))
        found = texts.mapInArrow(_stringer(length, q, wanted, (bits, bits)), f"{_WHOLE}, string binary")
        found = found.dropDuplicates(["gram", "wa", "wb"]).join(left, ["gram", "wa", "wb"])
        strings = staged(found.select("gram", "rid", "lo", "w", "d", "string", F.col("hot").cast("int").alias("hot")), "repeat-strings", ["hot"])
        cold = strings.where("hot = 0").select("gram", "rid", "lo", "w", "string").repartition("gram").sortWithinPartitions("gram")
        out = staged(cold.mapInArrow(_refiner(length, TOGETHER), "rid long, lo int, w int"), "repeat-refined")
        if not buckets.where("hot").isEmpty():
            blocks = strings.where("hot = 1").select("gram", "rid", "lo", "w", "d", "string")
            kind = "rid long, gram long, s0 int, p int, ca long, cb long, left binary, right binary, mask int"
            out = out.unionByName(_refined_blocks(staged(blocks.mapInArrow(_blocker(length), kind), "repeat-blocks")))
        return out


def repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: id, n_bytes, starts, ends, n_removed, kept_sha256; spans are in bytes, and null where nothing goes."""
    found = _Found(docs, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = marked(docs.select(text.alias("text"), F.sha2(text, 256).alias("sha")), found.marks.select("sha"), "sha").where("may").drop("may").join(found.marks, "sha")
    cut = cut.mapInArrow(_cutter(length, texts=False), "sha string, starts array<long>, ends array<long>, n_removed long, kept_sha256 string")
    # a text without copies has one row here, so the cut texts' side has each key once
    out = found.rows.select("id", "sha").join(found.classes, "sha").join(staged(cut, "repeat-cut"), "sha", "left")
    whole = F.col("all_goes")
    return out.select(
        "id",
        "n_bytes",
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(whole, F.array(F.col("n_bytes"))).otherwise(F.col("ends")).alias("ends"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def repeat_sizes(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("starts"))
    return repeated(docs, length).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", spans.cast("long").alias("n_spans"), "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with every repeated string of length bytes cut from the texts, whole characters only.

    A document left without words is dropped; one that had none stays as it is.
    """
    columns = docs.columns
    found = _Found(docs, length)
    goes = found.classes.where("all_goes").select("sha").withColumn("lo", F.lit(None).cast("array<int>")).withColumn("w", F.lit(None).cast("array<int>"))
    fate = staged(found.marks.select("sha", "lo", "w").unionByName(goes), "repeat-fate")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    told = marked(docs.select(row.alias("row"), F.sha2(text, 256).alias("sha")), fate.select("sha"), "sha")
    again = staged(told.where("may").select("row", "sha").join(fate.withColumn("known", F.lit(True)), "sha", "left"), "repeat-texts")
    kind = T.StructType([again.schema["row"], T.StructField("cut", T.StringType())])
    cut = again.where("lo is not null").select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "lo", "w")
    cut = cut.mapInArrow(_cutter(length, texts=True), kind).where(F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    same = told.where("not may").select("row").unionByName(again.where("known is null").select("row"))
    out = cut.unionByName(same.withColumn("cut", F.lit(None).cast("string")))
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("cut").isNotNull(), F.length("cut")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
