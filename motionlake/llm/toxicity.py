"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words, the beginnings of 3 to 6 letters of its words, how many distinct words share a
beginning (2 or 3, 4 and more), and the order of magnitude of its length; each is hashed to one of 2^20 places. A term alone may be harmless (an insult that
is also a plain word, a group's name); the machine gives every kept term a weight and a vector, so that pairs of terms
add the product of their vectors to the score: what an additive model misses.

Training reads at most ``most_rows`` labelled documents (a sample by hash; the only bound): the share of toxic documents with
each term is counted, terms that tell classes apart (likelihood ratio) are kept, and the machine is fitted to
the documents as lists of kept terms. The model holds at most ``most_terms`` rows of numbers, so it can be sent to every
task; texts are scored whole where they are.

Defined results: null, empty and wordless texts have no terms but their length and get that score; labels that are null, not 0 or 1, or without a document
teach nothing; a null ``doc_id`` is scored and never learned from; repeated rows count each time; with no label, or labels of
one class only, every score is the share of toxic labels, 0 without any; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
STEMS = (3, 4, 5, 6)
#: Labelled documents that are learned from, at most.
MOST_ROWS = 40_000
MOST_TERMS = 4096
LEAST_ROWS = 3
LEAST_RATIO = 8.0
FACTORS = 8
EPOCHS = 60
BATCH = 512
RATE = 0.05
DECAY = 2e-4
THRESHOLD = 0.7
HELD_OUT = 1
#: Distinct words whose terms a task remembers.
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are not learned from: CRC-32 of the id as text, mod 3, is 1; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def place(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << BITS) - 1)


class Terms:
    """Hashed terms of texts; with ``kept`` (place -> number) only those, as their numbers."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept, self.words, self.stems = kept, {}, {}

    def _find(self, term: str) -> int:
        p = place(term)
        return p if self.kept is None else self.kept.get(p, -1)

    def _word(self, word: str) -> tuple[int, tuple]:
        stems = []
        for k in STEMS:
            if len(word) >= k:
                s = word[:k]
                if s not in self.stems:
                    self.stems[s] = tuple(self._find(f"{kind}{s}") for kind in ("^", "2^", "4^"))
                if max(self.stems[s]) >= 0:
                    stems.append(s)
        return self._find(word), tuple(stems)

    def of(self, text: str | None) -> set[int]:
        words = Counter(_WORD.findall((text or "").lower()))
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.stems.clear()
        out, stems = {self._find(f"#{sum(words.values()).bit_length()}")}, []
        known, look = self.words, self._word
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = look(w)
            out.add(at[0])
            if at[1]:
                stems.extend(at[1])
        for s, n in Counter(stems).items():
            one, two, four = self.stems[s]
            out.add(one)
            if n >= 2:
                out.add(two)
            if n >= 4:
                out.add(four)
        out.discard(-1)
        return out


class Machine:
    """Bias, weights and vectors of the kept terms."""

    def __init__(self, places: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.kept = {int(p): i for i, p in enumerate(places)}
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def scores(self, terms: list) -> np.ndarray:
        """Probability that each list of kept terms is toxic."""
        sizes = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate([np.sort(np.fromiter(t, np.int64, len(t))) for t in terms]) if len(terms) else np.empty(0, np.int64)
        return _sigmoid(_raw(flat, sizes, self.bias, self.weights, self.vectors)[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _segments(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give 0."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    full = sizes > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _raw(flat, sizes, bias, weights, vectors):
    """Linear part and pairs: half of (sum of vectors)^2 less the sum of their squares."""
    v = vectors[flat]
    total = _segments(v, sizes)
    squares = _segments((v * v).sum(axis=1), sizes)
    return bias + _segments(weights[flat], sizes) + 0.5 * ((total * total).sum(axis=1) - squares), total, v


def learn(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) by Adam on the logistic loss with decaying weights; rows are runs of ``flat``."""
    rng = np.random.default_rng(seed)
    share = toxic.mean()
    size = 1 + n_terms * (1 + factors)
    x = np.zeros(size)
    x[0] = math.log(share / (1 - share))
    x[1 + n_terms :] = rng.normal(0, 0.02, n_terms * factors)
    m, s, step = np.zeros(size), np.zeros(size), 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    batches = max(1, -(-len(sizes) // BATCH))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        for rows in np.array_split(rng.permutation(len(sizes)), batches):
            n = sizes[rows]
            ids = flat[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            w, v = x[1 : 1 + n_terms], x[1 + n_terms :].reshape(n_terms, factors)
            raw, total, own = _raw(ids, n, x[0], w, v)
            error = (_sigmoid(raw) - toxic[rows]) / len(rows)
            each = np.repeat(error, n)
            grad = np.zeros(size)
            grad[0] = error.sum()
            grad[1 : 1 + n_terms] = np.bincount(ids, each, n_terms) + DECAY * w
            pairs = each[:, None] * (np.repeat(total, n, axis=0) - own)
            gv = grad[1 + n_terms :].reshape(n_terms, factors)
            for k in range(factors):
                gv[:, k] = np.bincount(ids, pairs[:, k], n_terms)
            gv += 2 * DECAY * v
            step += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad * grad
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return float(x[0]), x[1 : 1 + n_terms].copy(), x[1 + n_terms :].reshape(n_terms, factors).copy()


def likelihood_ratio(with_toxic: np.ndarray, with_all: np.ndarray, toxic: int, rows: int) -> np.ndarray:
    """G squared of term against label."""
    out = np.zeros(len(with_all))
    clean, share = rows - toxic, with_all / rows
    for seen, size in ((with_toxic, toxic), (with_all - with_toxic, clean)):
        for got, want in ((seen, size * share), (size - seen, size * (1 - share))):
            out += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1e-300) / np.maximum(want, 1e-300)), 0)
    return out


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``text, toxic`` of labelled documents, all or a sample by hash of about ``most_rows``."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("marked_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = marks.count()
    if rows > most_rows:
        marks = marks.filter(F.pmod(F.xxhash64("marked_id", F.lit(13)), F.lit(1 << 20)) < int((1 << 20) * most_rows / rows))
    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    return texts.join(common.broadcast_if_small(marks), F.col("doc_id") == F.col("marked_id")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> Machine:
    """The machine fitted to the labelled documents that are not held out."""

    def count(batches):
        # one task's counts of all places: 2^20 numbers for each class
        seen, rows, terms = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64), Terms()
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                ids = terms.of(text.as_py())
                seen[toxic, np.fromiter(ids, np.int64, len(ids))] += 1
                rows[toxic] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[1, at], rows[1])), pa.array(np.append(seen.sum(axis=0)[at], rows.sum()))], names=["place", "toxic", "rows"])

    rows = common.materialize(sample(docs, labels, most_rows), "toxicity-sample")
    counts = rows.mapInArrow(count, "place long, toxic long, rows long").groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    # at most 2^20 rows of three numbers, fewer after this filter
    found = counts.filter((F.col("rows") >= LEAST_ROWS) | (F.col("place") < 0)).toArrow().to_pydict()
    place_, toxic, seen = (np.array(found[c], np.int64) for c in ("place", "toxic", "rows"))
    all_rows = int(seen[place_ < 0].sum()) if len(place_) else 0
    all_toxic = int(toxic[place_ < 0].sum()) if len(place_) else 0
    share = all_toxic / all_rows if all_rows else 0.0
    if not 0 < share < 1:
        return Machine(np.empty(0, np.int64), 35.0 if share == 1 else -35.0, np.empty(0), np.empty((0, 1)))
    own = place_ >= 0
    place_, toxic, seen = place_[own], toxic[own], seen[own]
    ratio = likelihood_ratio(toxic, seen, all_toxic, all_rows)
    order = np.lexsort((place_, -ratio))
    order = order[ratio[order] >= LEAST_RATIO][:most_terms]
    kept = np.sort(place_[order])
    numbers = {int(p): i for i, p in enumerate(kept)}

    def listed(batches):
        terms = Terms(numbers)
        for b in batches:
            lists = [sorted(terms.of(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), b.column(1)], names=["terms", "toxic"])

    # the bounded sample as short lists of numbers, in an order that does not depend on how it was dealt
    data = rows.mapInArrow(listed, "terms array<int>, toxic int").toArrow().combine_chunks()
    common.discard(rows)
    lists = sorted(zip(data.column("terms").to_pylist(), data.column("toxic").to_pylist()))
    sizes = np.array([len(t) for t, _ in lists], np.int64)
    flat = np.array([i for t, _ in lists for i in t], np.int64)
    return Machine(kept, *learn(flat, sizes, np.array([y for _, y in lists], float), len(kept)))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id, text``), over whole texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        terms = Terms(model.kept)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores([terms.of(t.as_py()) for t in b.column(1)]), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the toxicity of every document."""
    common.bound_batches(spark)
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
