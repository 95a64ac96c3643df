"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (words, word pairs, and the shapes of words and pairs) are scaled by the log-count
ratios of the two classes; a linear hinge-loss model is fitted by dual coordinate descent, and its margins are mapped
to probabilities on held-back rows. Only the fit reads labels, from at most `max_rows` labelled documents, those with
the smallest id hashes, and as many of these, in that order, as have `max_features` features together; no text is cut.
Scoring reads whole texts and nothing else.

Defined results: a null or empty text scores by the intercept alone; labels are taken once per doc_id (the largest),
and so are the texts that are learned from (the one with the smallest hash); rows without a doc_id are only scored;
repeated rows score alike; without rows of both labels every score is the share of label 1, or 0.5 without labels; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import bytes as B
from quarry.scratch import shared, staged

BITS = 20


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def features(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature numbers of every row."""
    start, end, at = B.words(buf, offsets)
    h = B.word_hashes(buf, start, end, lower=False)
    n = len(h)
    if n:
        upper = (buf >= 65) & (buf <= 90)
        first, last = buf[start], buf[end - 1]
        same = np.concatenate([[False], h[1:] == h[:-1]])
        edge = at[(at > 0) & (at < n)]
        same[edge] = False
        second = np.minimum(start + 1, end - 1)
        letter = (last >= 97) & (last <= 122) | (last >= 128)
        shape = upper[start].astype(np.uint64) | upper[second].astype(np.uint64) << np.uint64(1) | same.astype(np.uint64) << np.uint64(2)
        shape |= np.where(letter, 0, last).astype(np.uint64) << np.uint64(8) | np.where(first < 65, first, 0).astype(np.uint64) << np.uint64(16)
        shape = B.mixed(shape, 61)
        kinds = [h, shape, B.pair(h[:-1], h[1:], 2), B.pair(shape[:-1], shape[1:], 62)]
    out = []
    cut = np.uint64(64 - BITS)
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b > a:
            own = np.concatenate([k[a : b - (len(k) < n)] for k in kinds]) >> cut
            out.append(np.unique(own.astype(np.uint32)))
        else:
            out.append(np.zeros(0, np.uint32))
    return out


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model by dual coordinate descent."""
    w, bias = np.zeros(1 << BITS), 0.0
    dual = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slack = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(dual[i] - slack / norm[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                w[x] += step * v
                bias += step
                dual[i] = new
    return w, bias


def _scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[row]
    return v / (np.sqrt(float(v @ v)) or 1.0)


def _fit_part(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for x, label in zip(rows, y, strict=True):
        counts[label][x] += 1.0
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [_scaled(x, ratio).astype(np.float32) for x in rows]
    share = np.bincount(y, minlength=2) / len(y)
    costs = cost * 0.5 / share[y]
    w, bias = fit_hinge(rows, values, np.where(y == 1, 1.0, -1.0), costs, epochs)
    return ratio, w, bias


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(weight[x] @ _scaled(x, ratio)) + bias for x in rows])


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic map, by Newton steps on smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        cross = (s * margin).sum()
        hess = np.array([[(s * margin * margin).sum() + 1e-3, cross], [cross, s.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 8) -> Model:
    y = np.asarray(y, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        none = np.zeros(1 << BITS)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    back = np.arange(len(y)) % 4 == 0
    slope, shift = 4.0, 0.0
    if all(len(set(y[m].tolist())) == 2 for m in (back, ~back)):
        ratio, w, bias = _fit_part([x for x, k in zip(rows, back, strict=True) if not k], y[~back], cost, epochs)
        slope, shift = _sigmoid_fit(margins([x for x, k in zip(rows, back, strict=True) if k], ratio, w, bias), y[back])
    return Model(*_fit_part(rows, y, cost, epochs), slope, shift)


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = B.values(batch.column("text"))
        for i, j in B.runs(offsets):
            rows = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = [batch.column(c).slice(i, j - i) for c in ("id", "quality")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in rows], type=pa.binary())], names=["id", "quality", "features"])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_features: int) -> pa.Table:
    """(quality, features) of the labelled documents outside the held-out fold that the fit reads."""
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    wanted = staged(wanted.orderBy(F.xxhash64("id"), "id").limit(max_rows), "quality-ids")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # max_rows bounds the broadcast side; copies of an id meet as one row of each task
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text")).join(F.broadcast(wanted), "id")
    rows = rows.groupBy("id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kind = "id long, quality int, features binary"
    got = staged(rows.mapInArrow(_featurer, kind).select(F.xxhash64("id").alias("h"), "*", (F.length("features") / 4).cast("long").alias("n")), "quality-rows")
    sizes = got.select("h", "id", "n").orderBy("h", "id").toArrow()
    taken = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), max_features, side="right"))
    if taken < sizes.num_rows:
        last = sizes.slice(taken, 1).to_pylist()[0]
        got = got.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("id") < last["id"]))
    return got.select("quality", "features").toArrow()


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, max_features: int = 12_000_000) -> Model:
    """The model of at most max_rows labelled documents, with max_features features together, outside the held-out fold."""
    got = sample(docs, labels, max_rows, max_features)
    found = sorted(zip(got.column("features").to_pylist(), got.column("quality").to_pylist(), strict=True), key=lambda r: (len(r[0]), r[0], r[1]))
    return fit([np.frombuffer(b, dtype=np.uint32) for b, _ in found], np.array([y for _, y in found], dtype=np.int64))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    # two arrays of 2**BITS numbers each
    sent = shared(spark, (model.ratio.astype(np.float32), model.weight.astype(np.float32)))
    bias, slope, shift = model.bias, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weight = sent.value
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                rows = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = 1 / (1 + np.exp(-np.clip(slope * margins(rows, ratio, weight, bias) + shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scan.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
