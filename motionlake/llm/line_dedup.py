"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of ascending ``doc_id``. A batch's lines are reduced to one row per key, merge-anti-joined
with the runs of all earlier batches, and the keys that are new become a run of their own: a table bucketed and sorted
by key hash, so the merge needs no shuffle of the runs. When a level holds ``fanout`` runs they are compacted into one
run of the next level. A line is dropped where an earlier batch, or a smaller ``doc_id`` of its own batch, holds its key.

Keys are two independent 64-bit hashes of the line, stripped of ASCII white space and with A-Z lower-cased.

Defined results: a null or empty text is one empty line; a null ``doc_id`` counts as the largest; rows that share a
``doc_id`` count as one document, so none of them loses a line to another; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_KEY = 10
BATCHES = 4
FANOUT = 2
HOT_KEYS = 1000


class LineRuns:
    """The persistent state: runs by level. ``add`` takes the keys of one batch and tells which of them were there before."""

    def __init__(self, spark, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or common.shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.merged: list[str] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = common.scratch_path(self.spark, name)
        # hashed to the buckets before the write, so each bucket is one file and its sort order holds
        keys.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").format("parquet").option("path", self.paths[name]).saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """``keys`` has one row per (h1, h2). Returns them with ``seen``: whether an earlier batch holds the key."""
        out = keys.withColumn("seen", F.lit(False))
        fresh = keys
        for level in self.levels:
            for name in level:  # each run is merged on its own buckets; unions would lose the bucketing
                fresh = fresh.join(self.spark.table(name).filter(~F.col("seen")).select("h1", "h2", F.lit(True).alias("hit")), ["h1", "h2"], "left")
                fresh = fresh.withColumn("old", F.coalesce(F.col("old") if "old" in fresh.columns else F.lit(False), F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit")
        if "old" in fresh.columns:
            out = fresh.withColumnRenamed("old", "seen")
        name = self._write(out)
        self._place(name, 0)
        return self.spark.table(name)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for n in self.levels[level]:
                part = self.spark.table(n).filter(~F.col("seen")).select("h1", "h2", "seen")
                merged = part if merged is None else merged.unionByName(part)
            self.merged += self.levels[level]
            self.levels[level] = []
            self._place(self._write(merged), level + 1)

    def sweep(self, everything: bool = False) -> None:
        """Drops the runs that compaction has replaced, or all of them; no open query may read them any more."""
        for name in [*self.merged, *(n for level in self.levels for n in level if everything)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.delete_path(self.spark, self.paths.pop(name))
        self.merged = []
        self.levels = [] if everything else self.levels


def line_keys(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2``: a row for each line whose key has at least ``min_key`` code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = common.ascii_lower(F.btrim("line", F.lit(common.ASCII_SPACE)))
    lines = lines.withColumn("key", key).filter(F.length("key") >= min_key)
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup(docs: DataFrame, batches: int = BATCHES, min_key: int = MIN_KEY, runs: LineRuns | None = None) -> DataFrame:
    """One row per document: ``doc_id, kept`` (its text without the dropped lines), ``n_lines, n_dropped``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    edges = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("e")).first().e or []
    batch = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        batch = F.when(F.col("doc_id") <= e, i).otherwise(batch)
    lines = common.materialize(line_keys(docs, min_key).withColumn("batch", batch), "lines", partition_by="batch")
    own_runs = runs is None
    runs = runs or LineRuns(spark)
    drops = None
    for b in range(len(edges) + 1):
        own = lines.filter(F.col("batch") == b).drop("batch")
        keys = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed"), F.count(F.lit(1)).alias("n"))
        step = runs.add(keys)
        shared = F.col("seen") | (F.col("owner") != F.col("last")) | (F.col("unnamed") & F.col("owner").isNotNull())
        verdict = step.filter(shared).select("h1", "h2", "owner", "seen", "n")
        # keys with more than a thousandth of the batch's lines: at most HOT_KEYS rows, broadcast; the rest meets by key
        most = (step.agg(F.sum("n")).first()[0] or 0) / HOT_KEYS
        for part in (F.broadcast(verdict.filter(F.col("n") > most)), verdict.filter(F.col("n") <= most)):
            hit = own.join(part.drop("n"), ["h1", "h2"]).filter(F.col("seen") | ~F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", "text_hash", "pos")
            drops = hit if drops is None else drops.unionByName(hit)
    drops = common.materialize(drops, "line-drops")
    common.discard(lines)
    runs.sweep(everything=own_runs)
    gone = drops.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")).withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left")
    out = out.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)), "\n"))
    return out.select("doc_id", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: line counts and the digest of what is kept of every document."""
    d = dedup(common.read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)
), o as (
  select key, min(doc_id) as owner, count(distinct doc_id) as n from l where length(key) >= 10 group by key
), k as (
  select l.doc_id, l.pos, l.line, coalesce(o.n >= 2 and l.doc_id <> o.owner, false) as gone from l left join o on l.key = o.key and length(l.key) >= 10
)
select doc_id, count(*)::BIGINT as n_lines, count(*) filter (where gone)::BIGINT as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from k group by doc_id
"""
