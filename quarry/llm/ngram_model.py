"""Language-model scores by deleted interpolation.

A token's probability mixes four estimates: the maximum-likelihood bigram, the maximum-likelihood unigram, the uniform
distribution over the known types and one unknown, and the unknown alone. The weights depend on how often the context
was seen (buckets by powers of two) and are learned by expectation-maximisation on held-back training documents,
scored with the counts of the others; final scores use the counts of all training documents.

Texts are gathered into blocks of `block_bytes` of one kind (counted, held back, only scored). A block sends its
distinct n-grams, sorted, to the owners of their hash ranges, gets their corpus-wide counts back in the same order,
and scores its texts with them, `STRETCH` tokens at a time. So an n-gram travels once per block, however frequent, and
no count table is broadcast. The number of ranges follows the corpus, one for `range_bytes` of text, so that no task
holds more than a block or a range. Messages are as many as blocks times ranges; they stay above a kilobyte up to some
hundred GB of text at the default sizes, and beyond that block_bytes should grow with the executors.

A word is a 64-bit hash; a bigram has BIGRAM_BITS bits, so that about n / 2**48 of n different bigrams share a count
with another one.

Defined results: a null text is empty and scores as its end token; without training documents every token is unknown;
repeated rows are separate documents, counted as often as they occur; a null doc_id counts as training; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.scratch import staged

MAIN, DEV, HELD = 0, 1, 2
END = np.uint64(0x8F1BBCDCBFA53E0B)
#: Hash bits of a bigram; a unigram keeps all 64.
BIGRAM_BITS = 48
#: Tokens that are scored together.
STRETCH = 1 << 18
#: Steps of a binary logarithm into which probabilities are rounded for the weights' histogram.
STEPS = 4
_CODEC = "zstd"


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, the first bytes of all first: high bytes of gaps and counts vary little."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob."""
    head = np.array([len(arrays), *(x.size for x in arrays), *(x.dtype.num for x in arrays)], dtype=np.int64)
    raw = head.tobytes() + b"".join(_planes(x).tobytes() if x.size else b"" for x in arrays)
    return np.int64(len(raw)).tobytes() + pa.Codec(_CODEC, 3).compress(raw).to_pybytes()


_KINDS = {np.dtype(k).num: np.dtype(k) for k in ("uint8", "uint32", "uint64", "int32", "int64")}


def _spread(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec(_CODEC).decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], dtype=np.int64)[0])).to_pybytes()
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    head = np.frombuffer(raw[8 : 8 + 16 * n], dtype=np.int64)
    at, out = 8 + 16 * n, []
    for size, kind in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        dtype = _KINDS[kind]
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * dtype.itemsize, offset=at)
        out.append(planes if dtype.itemsize == 1 else np.ascontiguousarray(planes.reshape(dtype.itemsize, size).T).view(dtype).reshape(-1))
        at += size * dtype.itemsize
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, narrow where they fit."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.astype(np.uint32) if not len(gaps) or gaps.max() < 1 << 32 else gaps


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def stream(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with every row's end, bigram keys, n + 1 offsets of the rows among the tokens)."""
    parts, at = [], [np.zeros(1, dtype=np.int64)]
    done = 0
    for i, j in B.runs(offsets, STRETCH):
        part = buf[offsets[i] : offsets[j]]
        start, end, own = B.words(part, offsets[i : j + 1] - offsets[i])
        ends = own[1:] + np.arange(1, j - i + 1)
        tokens = np.full(ends[-1], END, dtype=np.uint64)
        inner = np.ones(ends[-1], dtype=bool)
        inner[ends - 1] = False
        tokens[inner] = B.word_hashes(part, start, end)
        parts.append(tokens)
        at.append(ends + done)
        done += int(ends[-1])
    tokens = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    del parts
    pairs = np.empty_like(tokens)
    for i in range(0, len(tokens), STRETCH):
        own = tokens[i : i + STRETCH]
        before = np.concatenate([tokens[i - 1 : i] if i else [END], own[:-1]]).astype(np.uint64)
        pairs[i : i + STRETCH] = B.pair(before, own, 71) >> np.uint64(64 - BIGRAM_BITS)
    return tokens, pairs, np.concatenate(at)


def _cuts(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where sorted keys pass from one of the equal hash ranges to the next."""
    edges = [(k << bits) // parts for k in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]])


class _Block:
    """Texts of one kind on their way into a block."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.texts: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0


BLOCK_SCHEMA = "block long, cls int, part int, ids array<long>, n long, blob binary, kind int"


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "cls": pa.int32(), "part": pa.int32(), "ids": pa.list_(pa.int64()), "n": pa.int64(), "blob": pa.binary(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], type=k) for c, k in kinds.items()], names=list(kinds))


def _blocker(block_bytes: int, parts: int):
    def flush(block: _Block, number: int, cls: int) -> Iterator[pa.RecordBatch]:
        buf = np.frombuffer(b"".join(block.texts), dtype=np.uint8)
        sizes = np.concatenate(block.sizes).astype(np.int64)
        tokens, pairs, _ = stream(buf, np.concatenate([[0], np.cumsum(sizes)]))
        n_tokens = len(tokens)
        ids = pa.concat_arrays(block.ids).to_pylist()
        block.__init__()
        yield _rows({"block": [number], "cls": [cls], "part": [None], "ids": [ids], "n": [n_tokens], "blob": [_squeezed(buf, sizes.astype(np.int64))], "kind": [0]})
        del buf
        one, one_n = _distinct(tokens)
        del tokens
        two, two_n = _distinct(pairs)
        del pairs
        a, b = _cuts(one, 64, parts), _cuts(two, BIGRAM_BITS, parts)
        blobs = [_squeezed(_gaps(one[a[k] : a[k + 1]]), one_n[a[k] : a[k + 1]].astype(np.uint32), _gaps(two[b[k] : b[k + 1]]), two_n[b[k] : b[k + 1]].astype(np.uint32)) for k in range(parts)]
        yield _rows({"block": [number] * parts, "cls": [cls] * parts, "part": list(range(parts)), "ids": [None] * parts, "n": [None] * parts, "blob": blobs, "kind": [1] * parts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        open_blocks = {k: _Block() for k in (MAIN, DEV, HELD)}
        for batch in batches:
            kinds = batch.column("cls").to_numpy()
            for cls, block in open_blocks.items():
                part = batch.filter(pa.array(kinds == cls))
                buf, offsets = B.values(part.column("text"))
                for i, j in B.runs(offsets):
                    block.ids.append(part.column("doc_id").slice(i, j - i))
                    block.texts.append(buf[offsets[i] : offsets[j]].tobytes())
                    block.sizes.append(np.diff(offsets[i : j + 1]))
                    block.bytes += int(offsets[j] - offsets[i])
                    if block.bytes >= block_bytes:
                        yield from flush(block, number, cls)
                        number += 1
        for cls, block in open_blocks.items():
            if block.ids:
                yield from flush(block, number, cls)
                number += 1

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Corpus-wide counts of a hash range, for every block in the order it sent its n-grams."""
    cls = table.column("cls").to_pylist()
    sent = [_spread(b) for b in table.column("blob").to_pylist()]
    answers: list[list[np.ndarray]] = [[] for _ in sent]
    types = [0, 0]
    for level in (0, 2):
        keys = [_sums(s[level]) for s in sent]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        edges = np.cumsum([0, *map(len, keys)])
        count = np.concatenate([s[level + 1] for s in sent]).astype(np.float64)
        kind = np.repeat(np.array(cls), np.diff(edges))
        both = [np.bincount(inverse[kind == k], weights=count[kind == k], minlength=len(found)) for k in (MAIN, DEV)]
        if level == 0:
            types = [int((both[0] > 0).sum()), int((both[0] + both[1] > 0).sum())]
        for k in range(len(sent)):
            at = inverse[edges[k] : edges[k + 1]]
            answers[k] += [b[at].astype(np.uint32) if b.max(initial=0) < 1 << 32 else b[at].astype(np.uint64) for b in both]
    blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
    blobs = [_squeezed(*a) for a in answers]
    return pa.table(
        {
            "block": pa.array([*blocks, None], type=pa.int64()),
            "part": pa.array([part] * (len(blocks) + 1), type=pa.int32()),
            "blob": pa.array([*blobs, None], type=pa.binary()),
            "types_main": pa.array([None] * len(blocks) + types[:1], type=pa.int64()),
            "types": pa.array([None] * len(blocks) + types[1:], type=pa.int64()),
        }
    )


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys, all of them among the sorted known ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([np.ones(min(len(keys), 1), dtype=bool), ordered[1:] != ordered[:-1]])
    found = values[np.searchsorted(known, ordered[new])]
    out = np.empty(len(keys), dtype=values.dtype)
    out[order] = found[np.cumsum(new) - 1]
    return out


def _counted(text: pa.Table, answers: pa.Table, whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole rows: (first row, row ends, and every token's count, context's count and bigram's count).

    whole: with the counts of held-back documents.
    """
    order = np.argsort(answers.column("part").to_numpy())
    blobs = answers.column("blob")
    parts = [_spread(blobs[int(k)].as_py()) for k in order]
    pick = lambda k: np.concatenate([p[k].astype(np.int64) for p in parts])
    one, two = (pick(k) + (pick(k + 1) if whole else 0) for k in (0, 2))
    del parts
    buf, sizes = _spread(text.column("blob")[0].as_py())
    tokens, pairs, at = stream(buf, np.concatenate([[0], np.cumsum(sizes)]))
    del buf
    types, pair_types = _distinct(tokens)[0], _distinct(pairs)[0]
    end = one[np.searchsorted(types, END)]
    i, rows = 0, len(at) - 1
    while i < rows:
        j = min(max(int(np.searchsorted(at, at[i] + STRETCH, side="right")) - 1, i + 1), rows)
        c1 = _looked_up(tokens[at[i] : at[j]], types, one)
        c2 = _looked_up(pairs[at[i] : at[j]], pair_types, two)
        # the token before a row's first is an end
        yield i, at[i + 1 : j + 1] - at[i], c1, np.concatenate([[end], c1[:-1]]), c2
        i = j


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _estimates(c1: np.ndarray, before: np.ndarray, c2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(c2 / np.maximum(before, 1), 1.0), c1 / max(n, 1)


def _rounded(p: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the rounded steps of -log2."""
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log2(np.where(p > 0, p, 1.0)) * STEPS)
    return np.where(p > 0, steps + 1, 0).astype(np.int64)


def _eventer(n_main: int):
    def run(text: pa.Table, answers: pa.Table) -> pa.Table:
        if not text.num_rows:
            return pa.table({"event": pa.array([], type=pa.int64()), "n": pa.array([], type=pa.int64())})
        total: dict[int, int] = {}
        for _, _, c1, before, c2 in _counted(text, answers, whole=False):
            p2, p1 = _estimates(c1, before, c2, n_main)
            event, n = np.unique(bucket(before) << 40 | _rounded(p2) << 20 | _rounded(p1), return_counts=True)
            for e, k in zip(event.tolist(), n.tolist(), strict=True):
                total[e] = total.get(e, 0) + k
        return pa.table({"event": pa.array(list(total), type=pa.int64()), "n": pa.array(list(total.values()), type=pa.int64())})

    return run


def learn_weights(events: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """(64, 4) mixture weights per context bucket, by expectation-maximisation; thin buckets lean on the overall ones."""
    at, q2, q1 = events >> 40, events >> 20 & 0xFFFFF, events & 0xFFFFF
    value = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0)
    p = np.stack([value(q2), value(q1), np.full(len(events), 1.0 / (types + 1)), (q1 == 0).astype(np.float64)], axis=1)
    prior = np.array([0.3, 0.4, 0.2, 0.1])
    if not len(events):
        return np.tile(prior, (64, 1))

    def maximised(weights: np.ndarray, row: np.ndarray, strength: float) -> np.ndarray:
        lean = weights[0].copy()
        for _ in range(rounds):
            share = weights[row] * p
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            total = np.zeros_like(weights)
            np.add.at(total, row, share)
            total += strength * lean
            weights = total / total.sum(axis=1, keepdims=True)
        return weights

    overall = maximised(prior[None, :], np.zeros(len(events), dtype=np.int64), 1e-3)[0]
    overall = np.maximum(overall, 1e-9)
    return maximised(np.tile(overall / overall.sum(), (64, 1)), at, 5.0)


def _scorer(weights: np.ndarray, n_train: int, types: int):
    def run(text: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not text.num_rows:
            return pa.table({c: pa.array([], type=k) for c, k in names.items()})
        found: list[list[np.ndarray]] = [[], [], [], []]
        for _, ends, c1, before, c2 in _counted(text, answers, whole=True):
            p2, p1 = _estimates(c1, before, c2, n_train)
            at = bucket(before)
            p = weights[at, 0] * p2 + weights[at, 1] * p1 + weights[at, 2] / (types + 1) + weights[at, 3] * (c1 == 0)
            base = np.log10((c1 + 0.5) / (n_train + 0.5 * (types + 1)))
            first = np.concatenate([[0], ends[:-1]])
            for own, x in zip(found, (ends - first, *(np.add.reduceat(x, first) for x in ((c1 > 0).astype(np.int64), base, np.log10(p)))), strict=True):
                own.append(x)
        ids = text.column("ids").combine_chunks().values
        return pa.table([ids, *[pa.array(np.concatenate(x)) for x in found]], names=list(names))

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 1, F.lit(False))


def scored(docs: DataFrame, block_bytes: int = 10 << 20, held_back: int = 20, range_bytes: int = 12 << 20) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    One training document in held_back learns the weights. range_bytes: bytes of text for each hash range.
    """
    doc_id = F.col("doc_id").cast("long")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
    parts = max(1, -(-int(size or 0) // range_bytes))
    back = F.pmod(F.xxhash64(doc_id, F.lit("held back")), F.lit(held_back)) == 0
    scan = docs.select(
        doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(held_out(F.col("doc_id")), HELD).when(back, DEV).otherwise(MAIN).cast("int").alias("cls")
    )
    sent = staged(scan.mapInArrow(_blocker(block_bytes, parts), BLOCK_SCHEMA), "ngram-blocks", ["kind"])
    texts = sent.where("kind = 0").select("block", "cls", "ids", "n", "blob")
    kinds = "block long, part int, blob binary, types_main long, types long"
    answers = sent.where("kind = 1").select("block", "cls", "part", "blob").groupBy("part").applyInArrow(_totals, kinds)
    answers = staged(answers, "ngram-totals")
    sums = answers.where("block is null").agg(F.sum("types_main"), F.sum("types")).first()
    types_main, types = int(sums[0] or 0), int(sums[1] or 0)
    sizes = {r["cls"]: int(r["n"]) for r in texts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    n_main, n_train = sizes.get(MAIN, 0), sizes.get(MAIN, 0) + sizes.get(DEV, 0)
    answers = answers.where("block is not null").select("block", "part", "blob")
    dev = texts.where(F.col("cls") == DEV).select("block", "blob", "ids")
    some = answers.join(dev.select("block"), "block", "left_semi")
    events = dev.groupBy("block").cogroup(some.groupBy("block")).applyInArrow(_eventer(n_main), "event long, n long")
    # rounded probabilities bound the histogram
    events = events.groupBy("event").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(events["event"].to_numpy().astype(np.int64), events["n"].to_numpy().astype(np.float64), types_main)
    pieces = texts.select("block", "blob", "ids").groupBy("block").cogroup(answers.groupBy("block"))
    out = pieces.applyInArrow(_scorer(weights, n_train, types), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
