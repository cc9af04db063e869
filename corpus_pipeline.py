"""A training-corpus pipeline over ``documents``: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again as the next stage's input. All stages but the last return the
columns of ``documents``. SQL cannot express the stages (context trees, 64-bit hash permutations), so ``ORACLE_SQL`` is
None and the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import common, decontamination, jaccard_join, language_id, mixing, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is kept if one language's posterior exceeds all others together.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null or empty text, no letters, or no language with most of the posterior. A null
    ``doc_id`` is predicted, not learned from; repeated rows all stay; with nothing to learn from nothing is kept; other columns are left out."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    rated = language_id.predict(docs.select(*COLUMNS), model)
    return rated.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > LEAST_SCORE)).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the first by ``doc_id`` (nulls last), of each component of five-word shingle sets with Jaccard 0.8 or
    more. Documents without words are no copies of each other and stay; rows that repeat as a whole stay
    once; an empty table stays empty."""
    copies = jaccard_join.copies_to_drop(docs, n=5, percent=80)
    rows = docs.select(*COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_hash"))
    rows = rows.join(common.broadcast_if_small(copies), same, "left_anti")
    repeated = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).count().filter("count > 1").limit(1).count()
    # whole rows that repeat; most corpora have none, and then the texts need not be dealt again
    return rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h") if repeated else rows


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of ten consecutive words of a benchmark item (or a whole shorter item). Null and
    wordless texts hold none and stay, as do repeated rows and rows without ``doc_id``; an empty table stays empty."""
    found = decontamination.scan(docs, common.read(spark, sf_dir, "benchmark"))
    hit = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    rows = docs.select(*COLUMNS)
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, read back from its shards: a row for each time a document is taken, in the order of shard and shuffle key; the
    document a quota ends in is cut after its last taken word. Rows of null or blank text have no words and are never taken; a null
    ``doc_id`` or source is an ordinary value; a row that repeats is taken as often as its copies together; an empty table stays empty."""
    planned, mixture = mixing.mix(docs)
    takes = F.collect_list(F.struct("shard", "shuffle_key", "words")).alias("takes")  # at most three of a row
    taken = mixture.groupBy("row", F.col("doc_id").alias("t_id"), "text_hash", F.col("source").alias("t_source"), "size").agg(takes)
    rows = docs.select(*COLUMNS).withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    key = ["doc_id", "h", "source"]
    if rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(key)
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("text_hash")) & F.col("source").eqNullSafe(F.col("t_source"))
    # each text is dealt to its takes once and stored small, before it is repeated and dealt by shard
    rows = common.materialize(rows.join(taken, same).select(*COLUMNS, "size", "takes"), "mix-texts", compression="zstd")
    common.discard(planned, mixture)
    rows = rows.select(*COLUMNS, "size", F.explode("takes").alias("t")).select(*COLUMNS, "size", "t.*")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.repartitionByRange(common.shuffle_partitions(spark), "shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")
    return rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.length("text").cast("long"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard (0 to 23, bytes near equal) and slot of every row: null texts count 0 bytes, repeated rows are separate records, an
    empty table gives no rows."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", by_language),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(before)
    return docs
