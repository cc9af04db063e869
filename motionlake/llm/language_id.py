"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, orders 0 to 3 over all 256 bytes, with escape method C and full exclusion: a symbol that
a context has not seen costs the context's escape probability and is then coded by the next shorter context among the
symbols that remain. The statistics are frozen after training, so a symbol's exact code length depends only on the three
bytes before it. A tree is kept as sorted sparse tables, for each order the grams it has seen with their code lengths and
the contexts with what an escape from them costs, so its size follows the training sample. The language
with the shortest code wins; the score is its posterior under equal priors.

Training reads a bounded sample: about ``sample_bytes`` of text per language (at most ``sample_total`` in all), drawn
by a hash of ``doc_id`` from the rows that may be learned from, documents of at most ``max_doc_bytes`` only; the trees that are
broadcast hold at most four grams of 12 bytes and as many contexts for each byte of it. Prediction reads every whole text.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when nothing could be learned; ties go
to the language first in code point order; a null ``doc_id`` is predicted but not learned from; repeated rows are
separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 3
SAMPLE_BYTES = 600_000
SAMPLE_TOTAL = 16_000_000
MAX_DOC_BYTES = 64_000
UNDETERMINED = "und"
PAD = b"   "
#: Bytes of text looked up at once.
SLICE = 1 << 19


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte gram that ends at every byte of the texts, as a number, and where each text's grams begin."""
    raw = np.frombuffer(b"".join([PAD + t for t in texts]), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    code = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]) if len(raw) > 3 else np.empty(0, np.uint32)
    own = np.ones(len(raw), bool)
    heads = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    for i in range(len(PAD)):
        own[heads + i] = False
    return code[own[3:]], np.cumsum(sizes) - sizes


class Tree:
    """The context tree of one language: for each order the sorted ``grams`` with their ``bits``, the sorted ``contexts`` and what an ``escape`` costs."""

    def __init__(self, texts: list[bytes]):
        codes, _ = _grams(texts)
        self.grams, self.bits, self.contexts, self.escape = [], [], [], []
        for order in range(ORDER + 1):
            own, count = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_counts=True)
            contexts, at = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            shorter = np.exp2(-self.lengths(own, order - 1))
            rest = np.maximum(1 - np.bincount(at, shorter), 1e-12)  # of the shorter context's probability: what is not seen here
            escapes = kinds < 256  # else nothing is left to escape to
            room = total + np.where(escapes, kinds, 0)
            self.grams.append(own)
            self.bits.append(-np.log2(count / room[at]))
            self.contexts.append(contexts)
            self.escape.append(np.where(escapes, -np.log2(kinds / room / rest), 0.0))

    def lengths(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length in bits of the last byte of each gram after the ``order`` bytes before it."""
        if order < 0:
            return np.full(len(codes), 8.0)
        own = codes & np.uint32((1 << 8 * (order + 1)) - 1)
        grams, contexts = self.grams[order], self.contexts[order]
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        out = self.bits[order][at]
        miss = np.flatnonzero(grams[at] != own)
        if len(miss):
            context = own[miss] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[miss] = np.where(contexts[at] == context, self.escape[order][at], 0.0) + self.lengths(own[miss], order - 1)
        return out


class Model:
    """The trees of all languages."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        lo, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SLICE or i == len(texts) - 1:
                out[lo : i + 1] = self._slice(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out

    def _slice(self, texts: list[bytes]) -> np.ndarray:
        codes, first = _grams(texts)
        filled = np.array([len(t) > 0 for t in texts])
        out = np.zeros((len(texts), len(self.trees)))
        if len(codes):
            distinct, at = np.unique(codes, return_inverse=True)  # natural text repeats its grams
            for k, tree in enumerate(self.trees):
                out[filled, k] = np.add.reduceat(tree.lengths(distinct)[at], first[filled])
        return out


def compile_model(samples: dict[str, list[bytes]]) -> Model:
    languages = sorted(k for k, v in samples.items() if any(v))
    return Model(languages, [Tree(samples[k]) for k in languages])


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_total: int = SAMPLE_TOTAL, max_doc_bytes: int = MAX_DOC_BYTES) -> Model:
    """Learns from the rows of ``docs`` (``doc_id, text, lang``); see the module for the bounds of the sample."""
    spark = docs.sparkSession
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= max_doc_bytes))
    held = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    each = min(sample_bytes, sample_total // max(1, len(held)))
    shares = spark.createDataFrame([(r.lang, each / max(1, r.bytes)) for r in held], "lang string, share double")
    unit = F.xxhash64(F.lit(3), "doc_id") / F.lit(float(1 << 64)) + 0.5
    drawn = usable.join(F.broadcast(shares), "lang").filter(unit < F.col("share")).select("lang", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in drawn:
        samples.setdefault(r.lang, []).append(r.text.encode())
    return compile_model(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced). Only ``text`` is read for
    the prediction; all columns pass through."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0)]
            lettered = np.asarray(batch.column(1).to_pylist(), bool) & bool(m.languages)
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(lettered)
            if len(rows):
                bits = m.lengths([texts[i] for i in rows])
                best = bits.argmin(axis=1)
                scores[rows] = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for i, b in zip(rows.tolist(), best.tolist()):
                    names[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[2:], "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("text").alias("_text"), lettered.alias("_lettered"), *[f.name for f in kept])
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out():
    """Rows that the contract keeps out of training: crc32 of the decimal ``doc_id`` is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the predicted language of every document."""
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs.filter(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
