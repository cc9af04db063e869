"""Benchmark decontamination by a positional inverted index.

``build_index`` turns the corpus into segments of a few MB of text. A segment is one Parquet row: its terms in sorted
postings (positions in the segment's word stream, delta coded and split into byte planes so that they compress), the
terms' counts and the documents' lengths. Term counts of all segments give the order of rarity over the whole corpus.
A test window is looked up in a segment only if all its terms are there; its lists are intersected offset-adjusted from
the rarest term on. With ``slop`` 0 the result is exact phrases; with ``slop`` k it is proximity: every term within k
words of its place. Segments are independent, so nothing is shuffled and a very common passage costs no more than its text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Windows are ``window`` consecutive item
words; an item of fewer, but not none, is one window.

Defined results: a null or wordless text has 0 words and no hit; a null or wordless item has no window; repeated items
match under each of their ids; a null ``item_id`` matches as a null item; a null ``doc_id`` is an ordinary row; repeated
rows are separate rows; empty tables give an empty result or no hits.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT_BYTES = 2 << 20
#: Parquet holds a file's rows in memory when it writes a row group and when it reads a batch, by number and not by bytes: segments are
#: filed by few.
FILE_SEGMENTS = 8
#: Test windows are broadcast in slices of about so many (at most 44 bytes each in a worker); more slices mean more passes over the index.
SLICE_WINDOWS = 1_000_000
INDEX_SCHEMA = "segment long, doc_ids array<long>, text_hashes array<long>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"
MATCH_SCHEMA = "segment long, ordinal int, doc_id long, text_hash long, n_words long, spans array<struct<first:int,last:int>>, items array<long>, no_item boolean"

# every separator to a space, A-Z to a-z, all bytes of non-ASCII characters kept
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Segment:
    """A segment under construction: texts are turned into numbers of their words as they come and are not kept."""

    def __init__(self, number: int):
        self.number, self.names, self.hashes, self.sizes = number, [], [], []
        self.numbers, self.stream, self.held = _Numbers(), array("i"), 0

    def add(self, name, text: bytes, text_hash) -> None:
        w = words(text)
        self.names.append(name)
        self.hashes.append(text_hash)
        self.sizes.append(len(w))
        self.stream.extend(map(self.numbers.__getitem__, w))
        self.held += len(text)

    def row(self) -> pa.RecordBatch:
        ids = np.frombuffer(self.stream, np.int32) if self.stream else np.empty(0, np.int32)
        at = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.numbers)).astype(np.int32)
        gaps = np.diff(at, prepend=0).astype("<u4")
        heads = (np.cumsum(counts) - counts)[counts > 0]
        gaps[heads] = at[heads]
        del at, ids
        planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
        row = {"segment": [self.number], "doc_ids": [self.names], "text_hashes": [self.hashes], "n_words": [self.sizes], "terms": [list(self.numbers)], "counts": [counts.tolist()], "postings": [planes]}
        return pa.RecordBatch.from_pydict(row, schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])


def build_index(docs: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the index of ``docs`` (``doc_id, text``) to ``path``."""
    def segments(batches):
        own = _Segment(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for name, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own.add(name, text.as_buffer().to_pybytes() if text.is_valid else b"", h)
                if own.held >= segment_bytes:
                    yield own.row()
                    own = _Segment(own.number + 1)
        if own.names:
            yield own.row()

    with common.arrow_batches(docs.sparkSession, 500):
        docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(segments, INDEX_SCHEMA).write.option("maxRecordsPerFile", FILE_SEGMENTS).parquet(path)


class _Windows:
    """Windows of a bounded slice of test items, grouped by length: terms as numbers, and the place of their item in ``items``."""

    def __init__(self, items: list[tuple], window: int):
        numbers = _Numbers()
        by_length: dict[int, tuple[list, list]] = {}
        self.items = [item for item, _ in items]
        for place, (_, text) in enumerate(items):
            w = np.array([numbers[x] for x in words((text or "").encode())], np.int32)
            size = min(window, len(w))
            if size:
                grid = np.lib.stride_tricks.sliding_window_view(w, size)
                terms, owners = by_length.setdefault(size, ([], []))
                terms.append(grid)
                owners.append(np.full(len(grid), place, np.int32))
        self.terms = list(numbers)
        self.groups = [(np.concatenate(t), np.concatenate(o)) for t, o in by_length.values()]
        self.rarity = np.zeros(len(self.terms), np.int64)


def _search(row: dict, wanted: _Windows, terms: pa.Array, slop: int):
    """(start, words covered, item) of all matches in one segment, and the segment's document starts."""
    sizes = np.asarray(row["n_words"], np.int64)
    ends = np.cumsum(sizes)
    counts = np.asarray(row["counts"], np.int64)
    first = np.cumsum(counts) - counts
    raw = np.frombuffer(row["postings"], np.uint8)
    planes = raw.reshape(4, -1)
    place = pc.index_in(pa.array(wanted.terms, pa.binary()), value_set=terms).to_numpy(zero_copy_only=False)
    there = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(len(place), bool)
    lists: dict[int, np.ndarray] = {}

    def positions(t: int) -> np.ndarray:
        if t not in lists:
            k = int(place[t])
            own = np.ascontiguousarray(planes[:, first[k] : first[k] + counts[k]].T).view("<u4").ravel()
            lists[t] = np.cumsum(own.astype(np.int64))
        return lists[t]

    for grid, owners in wanted.groups:
        size = grid.shape[1]
        for i in np.flatnonzero(there[grid].all(axis=1)).tolist():
            line = grid[i]
            start = None
            for o in np.argsort(wanted.rarity[line], kind="stable").tolist():
                own = positions(int(line[o]))
                if start is None:
                    start = own - o
                    # a match lies inside one document
                    start = start[start >= 0]
                    doc = np.searchsorted(ends, start, side="right")
                    start = start[(doc < len(ends)) & (start + size <= ends[np.minimum(doc, len(ends) - 1)])]
                else:
                    at = np.searchsorted(own, start + o - slop)
                    start = start[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= start + o + slop)]
                if not len(start):
                    break
            if start is not None and len(start):
                yield start, size, wanted.items[owners[i]]


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """One row per document row: ``segment, ordinal`` (its place in the index), ``doc_id, text_hash, n_words, spans`` (the word ranges hit),
    ``items`` (ids with a match) and ``no_item`` (a match of an item without id). ``slop`` counts the words a term may be
    off its place. ``index`` is the table that ``build_index`` wrote."""
    spark = index.sparkSession
    size = benchmark.agg(F.sum(F.regexp_count(common.ascii_lower(F.col("text")), F.lit(WORD)))).first()[0] or 0
    slices = max(1, -(-size // slice_windows))
    out = None
    for k in range(slices):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).select("item_id", "text")
        wanted = _Windows([tuple(r) for r in part.collect()], window)  # about slice_windows words
        terms = spark.createDataFrame(list(enumerate(wanted.terms)), "n int, term binary")
        used = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("count"))
        for r in used.join(F.broadcast(terms), "term").groupBy("n").agg(F.sum("count").alias("count")).collect():
            wanted.rarity[r.n] = r["count"]
        shared = spark.sparkContext.broadcast(wanted)

        def run(batches, shared=shared):
            w = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i] for n in ("segment", "doc_ids", "text_hashes", "n_words", "counts", "postings")}
                    row = {n: (v.as_py() if n != "counts" else v.values.to_numpy()) for n, v in row.items()}
                    yield _documents(row, w, batch.column("terms")[i].values, slop)

        own = index.mapInArrow(run, MATCH_SCHEMA)
        out = own if out is None else out.unionByName(own)
    if slices > 1:
        # a row of each slice for every place in the index; repeated documents have places of their own
        same = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")]
        out = out.groupBy("segment", "ordinal").agg(*same, F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.bool_or("no_item").alias("no_item"))
    return out


_MATCH_ARROW = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.int64())), ("no_item", pa.bool_())])


def _documents(row: dict, wanted: _Windows, terms: pa.Array, slop: int) -> pa.RecordBatch:
    sizes = np.asarray(row["n_words"], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    cover = np.zeros(total + 1, np.int64)
    items: dict[int, set] = {}
    for start, size, item in _search(row, wanted, terms, slop):
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
        for d in np.unique(np.searchsorted(ends, start, side="right")).tolist():
            items.setdefault(d, set()).add(item)
    hit = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(hit)
    spans: list[list] = [[] for _ in sizes]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        d = int(np.searchsorted(ends, a, side="right"))
        while a < b:  # a run may go on in the next document
            upto = min(b, int(ends[d]))
            if upto > a:
                spans[d].append({"first": a - int(begins[d]), "last": upto - int(begins[d])})
            a, d = max(a, upto), d + 1
    found = [items.get(d, set()) for d in range(len(sizes))]
    data = [[row["segment"]] * len(sizes), list(range(len(sizes))), row["doc_ids"], row["text_hashes"], sizes.tolist(), spans, [sorted(x for x in f if x is not None) for f in found], [None in f for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(data, _MATCH_ARROW)], schema=_MATCH_ARROW)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """Builds the index of ``docs`` in the shared folder, matches ``benchmark`` against it and deletes it."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "postings")
    build_index(docs, path)
    with common.arrow_batches(spark, 4):
        found = common.materialize(matches(spark.read.schema(INDEX_SCHEMA).parquet(path), benchmark, window, slop, slice_windows), "matches")
    common.delete_path(spark, path)
    return found


def n_hit():
    """Words inside any of the spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["end"]))).alias("n"))
    return F.aggregate(F.array_sort("spans"), zero, step, lambda a: a["n"])


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the words of every document that stand in a benchmark window."""
    m = scan(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
with lowered as (
  select 'd' as kind, doc_id as id, row_number() over () as rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', item_id, row_number() over (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), listed as (
  select kind, id, rid, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered
), wins as (
  select distinct id as item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') as gram
  from (select id, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from listed where kind = 'b' and len(w) > 0)
), sizes as (select distinct size from wins),
grams as (
  select rid, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') as gram
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as p from listed, sizes where kind = 'd' and len(w) >= size)
), hits as (select g.rid, g.p, g.size, w.item_id from grams g join wins w on g.gram = w.gram and g.size = w.size),
cover as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + size)) as q from (select distinct rid, p, size from hits)) group by rid),
named as (select rid, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct rid, item_id::VARCHAR as name from hits) group by rid)
select l.id as doc_id, len(l.w)::BIGINT as n_words, coalesce(c.n_hit, 0)::BIGINT as n_hit, coalesce(n.n_items, 0)::BIGINT as n_items,
       sha256(coalesce(n.names, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from listed l left join cover c on l.rid = c.rid left join named n on l.rid = n.rid where l.kind = 'd'
"""
