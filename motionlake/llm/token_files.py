"""Token ids in ascending ``doc_id`` order as patched frame-of-reference files (see ``pfor``).

Documents are range-partitioned by ``doc_id``; each task encodes its range and cuts it into segments of about
``segment_ids`` ids. A segment is one self-contained image; images are the ``image`` column of a Parquet table in the
shared folder, so they are written and read by Spark's committers on any store, and a lost task is simply rerun. A
range's segments carry their start within the range; the starts of the ranges are one row per range.

Words between ASCII white space encode independently of each other with the default vocabulary (its pre-tokenizer never
crosses white space), so a worker keeps a bounded table of the words it has met. A new word of Latin-1 letters, with or
without ASCII punctuation after it, goes to the library's BPE model directly (its normalizer only lower-cases such words
and its pre-tokenizer keeps the letters together); every other new word takes the library's whole path.

Defined results: a null or empty text has only the end id; a null ``doc_id`` sorts first; rows that share a ``doc_id``
follow each other in the order of their texts' hashes; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pfor

END_ID = 1
SEGMENT_IDS = 1 << 20
KEPT_WORDS = 500_000
#: Ends of words that the pre-tokenizer makes one token of; the apostrophe, which starts contractions, is not among them.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
SPLIT = re.compile(r"[ \t\n\r\x0b\x0c]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
SEGMENT_SCHEMA = "range int, seq int, start long, n_ids long, doc_ids array<long>, image binary"


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters to what byte-level BPE reads for their UTF-8 bytes: printable bytes stand for themselves, the
    others for the characters from U+0100 on in ascending order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(chr(shifted.get(b, b)) for b in chr(c).encode()) for c in range(128, 256)}


class _Words(dict):
    """word -> its ids as little-endian bytes; emptied when it holds KEPT_WORDS words, so a worker's memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.cores: dict[str, bytes] = {}
        self.plain = self._plain()

    def _plain(self) -> bool:
        """Whether the vocabulary treats words as the direct way does; else every word takes the whole path."""
        probe = ["hello", "Straße,", "ÉTÉ...", "niño;", "x", "aÿa)", "Überhaupt!"]
        return all(self._direct(w) == self._whole(w) for w in probe)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _direct(self, word: str) -> bytes | None:
        core = word.rstrip(TAIL)
        if not core or max(core) > "\xff":
            return None
        low = core.lower()
        out = self.cores.get(low)
        if out is None:
            if not low.isalpha():
                return None
            if len(self.cores) >= KEPT_WORDS:
                self.cores.clear()
            out = self.cores[low] = array("I", [t.id for t in self.model.tokenize(low.translate(self.letters))]).tobytes()
        return out if len(core) == len(word) else out + self._tail(word[len(core) :])

    def _tail(self, tail: str) -> bytes:
        out = self.cores.get(tail)
        if out is None:
            out = self.cores[tail] = self._whole(tail)
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self._direct(word) if self.plain else None
        if out is None:
            out = self._whole(word)
        self[word] = out
        return out


_words: _Words | None = None


def _table(path: str) -> _Words:
    global _words
    if _words is None or _words.path != path:
        _words = _Words(path)
    return _words


def encode_text(text: str | None, table: _Words) -> bytes:
    if not text:
        return b""
    # str.split() also splits at \x1c-\x1f, which are no white space to the tokenizer
    words = [w for w in SPLIT.split(text) if w] if ODD_SPACE.search(text) else text.split()
    return b"".join([table[w] for w in words])


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the token files of ``docs`` (``doc_id, text``) to ``path``."""
    spark = docs.sparkSession
    tail = np.asarray([end_id], "<u4").tobytes()

    def segments(batches):
        table, at, seq = _table(vocabulary), 0, 0
        ids: list[bytes] = []
        lengths: list[int] = []
        names: list = []
        held = 0
        part = TaskContext.get().partitionId()

        def image():
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = {"range": [part], "seq": [seq], "start": [at], "n_ids": [held], "doc_ids": [names], "image": [pfor.encode(flat, np.asarray(lengths))]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())]))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = encode_text(text.as_py(), table) + tail
                ids.append(own)
                lengths.append(len(own) // 4)
                names.append(name)
                held += len(own) // 4
                if held >= segment_ids:
                    yield image()
                    at, seq, held = at + held, seq + 1, 0
                    ids, lengths, names = [], [], []
        if names:
            yield image()

    ordered = docs.select("doc_id", "text").repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    with common.arrow_batches(spark, 500):
        ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document, decoded: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids`` (binary, u32 little endian)."""
    return _read(spark, path, digest=False)


def read_digests(spark, path: str) -> DataFrame:
    """As ``read``, with ``ids_crc32`` of the decoded ids in place of the ids."""
    return _read(spark, path, digest=True)


def _read(spark, path: str, digest: bool) -> DataFrame:
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    ranges = files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect()  # a row for each task of the writer
    base, starts = 0, []
    for r in ranges:
        starts.append((r.range, base))
        base += r.n
    based = files.join(F.broadcast(spark.createDataFrame(starts, "range int, base long")), "range")
    based = based.select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "image")

    def documents(batches):
        for batch in batches:
            for start, names, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = image.as_py()
                lengths, flat = pfor.lengths_of(image).astype(np.int64), pfor.decode(image).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                raw = flat.tobytes()
                spans = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist())
                last = [zlib.crc32(raw[a:b]) for a, b in spans] if digest else [raw[a:b] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(last, pa.int64() if digest else pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    common.bound_batches(spark)
    return based.mapInArrow(documents, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: writes the ids of all documents, reads the files back."""
    import public_tokenizers

    path = common.scratch_path(spark, "token-files")
    write(common.read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path)
