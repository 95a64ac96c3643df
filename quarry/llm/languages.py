"""Language identification by unigram piece models that sum over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word scores the sum, over all ways
to cut it into pieces, of the product of their probabilities, by the forward algorithm; a text scores the product
over its words (no piece spans two words). The probabilities are expected piece counts, by expectation-maximisation
on a bounded sample: at most `per_language` labelled documents of each language, those with the smallest hashes of id
and text. Executors find the words of the sample and the expected counts; the driver gets sums per piece only.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language first by code
point; without labelled rows every text is `und`; rows without an id are judged but never learned from, and rows that
repeat an id and its text are learned from once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bytes as B
from quarry.scratch import shared, staged

#: The vocabulary's path where no other is given, on the driver.
VOCABULARY = os.environ.get("QUARRY_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Words whose scores a worker keeps.
CACHE = 400_000
#: Words in one lattice.
WORDS = 4000
#: Expected counts are summed in whole numbers of this part, so that their order does not matter.
UNIT = float(1 << 20)


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Lower-case pieces of a sentencepiece file, without control and byte pieces, numbered from 0."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"{path}: no vocabulary; give a sentencepiece file as path or in QUARRY_VOCABULARY")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(p for p in found if p == p.lower()))}


class Tree:
    """Prefix tree of pieces, in arrays: steps from node and character by an open hash table."""

    def __init__(self, pieces: dict[str, int]):
        self.unknown = len(pieces)
        letters = sorted({ord(c) for p in pieces for c in p})
        self.letter = np.zeros(letters[-1] + 2 if letters else 1, dtype=np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.wide = len(letters) + 1
        nodes, piece = {"": 0}, [-1]
        edges: list[tuple[int, int]] = []
        for p in sorted(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(piece)
                    edges.append((nodes[p[: k - 1]] * self.wide + int(self.letter[ord(p[k - 1])]), len(piece)))
                    piece.append(-1)
            piece[nodes[p]] = pieces[p]
        self.piece = np.array(piece, dtype=np.int32)
        self.bits = max(len(edges), 1).bit_length() + 3
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.to = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.array(edges, dtype=np.int64).reshape(-1, 2)
        self.tries = 0
        while len(left):
            at = self._slot(left[:, 0], self.tries)
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.to[at[free]] = left[free, 0], left[free, 1]
            left = np.delete(left, free, axis=0)
            self.tries += 1

    def _slot(self, key: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + n) & ((1 << self.bits) - 1)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next nodes, -1 for none."""
        key = node * self.wide + letter
        at = self._slot(key, 0)
        got = self.keys[at]
        out = np.where(got == key, self.to[at], -1)
        on = np.flatnonzero((got != key) & (got >= 0))
        for n in range(1, self.tries):
            if not len(on):
                break
            at = self._slot(key[on], n)
            got = self.keys[at]
            hit = got == key[on]
            out[on[hit]] = self.to[at[hit]]
            on = on[~hit & (got >= 0)]
        return out


@dataclass
class Model:
    languages: list[str]
    tree: Tree
    #: (pieces + 1, languages); the last row is for a character that no piece covers.
    logs: np.ndarray
    prior: np.ndarray


class Lattice:
    """The ways to cut words into pieces: edges from node to node. A word's nodes are its characters and its end."""

    def __init__(self, words: list[str], tree: Tree):
        text = "".join(f"{MARK}{w}\n" for w in words).lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = codes == 10
        self.nodes, self.last = len(codes), np.flatnonzero(ends)
        self.first = np.concatenate([[0], self.last[:-1] + 1]).astype(np.int64)[: len(words)]
        letter = tree.letter[np.minimum(codes, len(tree.letter) - 1)]
        at = np.flatnonzero(~ends)
        node, depth = np.zeros(len(at), dtype=np.int64), 0
        parts = []
        while len(at):
            node = tree.step(node, letter[at + depth])
            piece = np.where(node >= 0, tree.piece[node], -1)
            if not depth:
                # a character that is no piece is an edge of its own
                piece = np.where(piece < 0, tree.unknown, piece)
            hit = piece >= 0
            parts.append((at[hit], at[hit] + depth + 1, piece[hit]))
            alive = node >= 0
            at, node, depth = at[alive], node[alive].astype(np.int64), depth + 1
        start, end, piece = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        word = np.cumsum(ends)[start] if len(start) else start
        level = start - self.first[word]
        order = np.argsort(level, kind="stable")
        self.start, self.end, self.piece, self.word = start[order], end[order], piece[order], word[order]
        #: Where the edges that start at the next place of their words begin.
        self.levels = np.flatnonzero(np.diff(level[order], prepend=-1, append=-1))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log sums over all paths from each word's start to each node; weight: of every edge."""
        total = np.full((self.nodes, weight.shape[1]), -np.inf)
        total[self.first] = 0.0
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            # edges from one place of a word end at different nodes
            to = self.end[a:b]
            total[to] = np.logaddexp(total[to], total[self.start[a:b]] + weight[a:b])
        return total

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Log sums over all paths from each node to its word's end."""
        total = np.full((self.nodes, weight.shape[1]), -np.inf)
        total[self.last] = 0.0
        for a, b in reversed(list(zip(self.levels[:-1], self.levels[1:], strict=True))):
            by = np.argsort(self.start[a:b], kind="stable") + a
            cut = np.flatnonzero(np.diff(self.start[by], prepend=-1))
            total[self.start[by[cut]]] = np.logaddexp.reduceat(total[self.end[by]] + weight[by], cut, axis=0)
        return total

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """(words, languages) log probabilities."""
        return self.forward(logs[self.piece])[self.last]

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """(pieces + 1, languages) expected counts in units, of words that occur so many times in each language."""
        weight = logs[self.piece]
        alpha, beta = self.forward(weight), self.backward(weight)
        share = np.exp(alpha[self.start] + weight + beta[self.end] - alpha[self.last][self.word]) * times[self.word]
        share = np.rint(share * UNIT)
        return np.stack([np.bincount(self.piece, weights=share[:, k], minlength=len(logs)) for k in range(logs.shape[1])], axis=1)


class Scorer:
    """Scores of texts, with the words' scores kept between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, dtype=np.uint64)
        self.table = np.zeros((0, len(model.languages)))

    def _word_scores(self, keys: np.ndarray, word) -> np.ndarray:
        """Scores of the distinct words with these sorted hashes; word: a call that gives the k-th."""
        if len(self.known) + len(keys) > CACHE:
            self.known, self.table = self.known[:0], self.table[:0]
        at = np.searchsorted(self.known, keys)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            rows = []
            for i in range(0, len(new), WORDS):
                part = [word(k).decode("utf-8", "replace") for k in new[i : i + WORDS].tolist()]
                rows.append(Lattice(part, self.model.tree).scores(self.model.logs))
            self.table = np.insert(self.table, at[new], np.concatenate(rows), axis=0)
            self.known = np.insert(self.known, at[new], keys[new])
            at = np.searchsorted(self.known, keys)
        return self.table[at]

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        start, end, at = B.words(buf, offsets)
        lower = B.LOWER[buf]
        ascii_letters = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
        lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~lettered):
            lettered[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        if not self.model.languages:
            return ["und"] * n, np.zeros(n)
        keys, first, inverse = np.unique(B.word_hashes(buf, start, end), return_index=True, return_inverse=True)
        raw, a, b = buf.tobytes(), start[first].tolist(), end[first].tolist()
        scores = self._word_scores(keys, lambda k: raw[a[k] : b[k]])[inverse]
        total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
        total = total[at[1:]] - total[at[:-1]] + self.model.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)


def held_out(doc_id: Column, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 1, F.lit(False))


def _word_counter(index: dict[str, int]):
    """Distinct words of every batch, with how often each language has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for i, j in B.runs(offsets):
                part = buf[offsets[i] : offsets[j]]
                start, end, at = B.words(part, offsets[i : j + 1] - offsets[i])
                keys, first, inverse = np.unique(B.word_hashes(part, start, end), return_index=True, return_inverse=True)
                own = np.repeat(lang[i:j], np.diff(at))
                counts = np.bincount(inverse * len(index) + own, minlength=len(keys) * len(index)).reshape(len(keys), len(index))
                raw = part.tobytes()
                words = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), *[pa.array(counts[:, k]) for k in range(len(index))]], names=["word", *[f"n{k}" for k in range(len(index))]])

    return run


def _expecter(state, columns: list[str]):
    """Expected counts of pieces, of all words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, logs = state.value
        total = np.zeros_like(logs)
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS):
                part = batch.slice(i, WORDS)
                times = np.stack([part.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)
                total += Lattice(part.column("word").to_pylist(), tree).expected(logs, times)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(total[seen, k].astype(np.int64)) for k in range(total.shape[1])]], names=["piece", *columns])

    return run


def fit(words: DataFrame, languages: list[str], prior: np.ndarray, pieces: dict[str, int], rounds: int = 4, smoothing: float = 0.05) -> Model:
    """Piece probabilities per language from rows (word, n0, n1, ...): how often each language has the word."""
    spark, tree, n = words.sparkSession, Tree(pieces), len(pieces) + 1
    columns = [f"n{k}" for k in range(len(languages))]
    logs = np.full((n, len(languages)), -np.log(n))
    for _ in range(rounds):
        # the vocabulary's pieces by languages bound what is sent and what comes back
        state = spark.sparkContext.broadcast((tree, logs))
        kinds = "piece long, " + ", ".join(f"{c} long" for c in columns)
        got = words.mapInArrow(_expecter(state, columns), kinds).groupBy("piece").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        state.destroy()
        expected = np.full((n, len(languages)), smoothing)
        at = got.column("piece").to_numpy()
        for k, c in enumerate(columns):
            expected[at, k] += got.column(c).to_numpy() / UNIT
        logs = np.log(expected / expected.sum(axis=0))
    return Model(languages, tree, logs, np.log(prior))


def sample(docs: DataFrame, per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of at most per_language documents of each language, outside the held-out fold; rows per language."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(doc_id, text).alias("h"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(~held_out(F.col("id")))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("d")).collect()
    span = 1 << 30
    chosen = F.lit(False)
    for r in found:
        # some more than wanted, before the exact cut
        share = min(span, 2 * span * per_language // max(int(r["d"]), 1) + 1)
        chosen = chosen | (F.col("lang") == r["lang"]) & (F.pmod("h", F.lit(span)) < share)
    some = rows.where(chosen).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h")
    some = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    return some.select("lang", "text"), {r["lang"]: int(r["n"]) for r in found}


def learned(docs: DataFrame, path: str = VOCABULARY, per_language: int = 300) -> Model:
    """The model of at most per_language labelled documents of each language, outside the held-out fold."""
    rows, sizes = sample(docs, per_language)
    pieces, languages = vocabulary(path), sorted(sizes)
    if not languages:
        return Model([], Tree({}), np.zeros((1, 0)), np.zeros(0))
    columns = [f"n{k}" for k in range(len(languages))]
    index = {x: k for k, x in enumerate(languages)}
    words = rows.mapInArrow(_word_counter(index), "word string, " + ", ".join(f"{c} long" for c in columns))
    words = staged(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]), "language-words")
    prior = np.array([sizes[k] for k in languages], dtype=np.float64)
    return fit(words, languages, prior / prior.sum(), pieces)


def _predictor(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            buf, offsets = B.values(batch.column("text"))
            for i, j in B.runs(offsets):
                lang, score = scorer.predict(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = [batch.column(c).slice(i, j - i) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, type=pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    # the vocabulary's pieces by languages bound the model
    sent = shared(docs.sparkSession, model)
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scan.mapInArrow(_predictor(sent, ["doc_id"]), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose language can be told: not `und`, and likelier than not."""
    sent = shared(docs.sparkSession, model)
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    scan = docs.select(row, F.col("text").cast("string").alias("text"))
    out = scan.mapInArrow(_predictor(sent, ["row"]), T.StructType([scan.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    kept = out.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
