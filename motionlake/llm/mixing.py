"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of whole documents along a permuted word stream. The source's target fixes an exact
quota of blocks (whole passes over the source, then blocks in permuted order until the remaining words are reached).
A tree halves the range of output shards again and again and splits the quota vector at each node by a multivariate
hypergeometric draw, so every shard gets an exact quota of every source's blocks. With many sources the draw has two
levels: groups of sources first, then the sources of each group given what the group got in every shard, which is the
same law; no step holds more than ``GROUP_SOURCES`` sources or a number for each group. Shards take disjoint runs of each
source's permuted block list; ``mix`` writes them, each in the order of a local shuffle key, and reads them back.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, ordered last; a null
``doc_id`` is an ordinary row; repeated rows are separate rows; the one document at the end of a source's quota may be
taken in part (``words`` < size); an empty table gives an empty result. Reruns agree: all permutations are hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
GROUP_SOURCES = 4_096
ROWS_PER_CELL = 4_000
MAX_BLOCKS = 200_000
MIN_BLOCK_WORDS = 1024
SHARDS = 24


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` (one row per source) with ``sid``: its place by code point, null last; ranks within ranges of sources plus the rows of the ranges before."""
    spark = sizes.sparkSession
    ranged = sizes.repartitionByRange(common.shuffle_partitions(spark), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = common.materialize(ranged, "mix-sources")
    before, start = [], 0
    for r in ranged.groupBy("range").count().orderBy("range").collect():  # a row for each task
        before.append((r.range, start))
        start += r["count"]
    starts = spark.createDataFrame(before, "range int, start long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    out = ranged.withColumn("rank", rank).join(F.broadcast(starts), "range").withColumn("sid", F.col("start") + F.col("rank"))
    return out.drop("range", "rank", "start")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (``source, source_size`` and other columns, one row per source) with ``sid, weight, target``.

    Targets share ``share`` of all words by weight; a target never exceeds ``cap`` times its source, and the excess is
    reshared by weight among the others until none is above: each turn is one aggregate over the sources.
    """
    s = numbered_sources(sizes)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    budget = float(share) * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, cap_sum, open_weight, saturated = -1.0, 0.0, 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        r = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not r.n and not r.open or r.n == saturated:
            break
        cap_sum, open_weight, saturated = r.caps, r.open, r.n
        if not open_weight:
            break
        level = (budget - cap_sum) / open_weight
    full = F.col("cap") <= F.col("weight") * F.lit(level)
    target = F.when(full | F.lit(not open_weight), F.col("cap")).otherwise(F.lit(budget - cap_sum) * F.col("weight") / F.lit(open_weight or 1.0))
    return s.withColumn("target", target).drop("cap")


def even_totals(total: int, n_shards: int) -> np.ndarray:
    """``total`` in ``n_shards`` near equal parts, as repeated halving gives them."""
    out = np.zeros(n_shards, np.int64)

    def split(n: int, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = n
            return
        mid = (lo + hi) // 2
        left = n * (mid - lo) // (hi - lo)
        split(left, lo, mid)
        split(n - left, mid, hi)

    split(int(total), 0, n_shards)
    return out


def splitting_tree(quotas, totals, seed) -> np.ndarray:
    """The quota of each row (source or group of sources) in every output shard (column). Rows sum to ``quotas``, columns to
    ``totals``; every split of a range of shards is a multivariate hypergeometric draw."""
    quotas, totals = np.asarray(quotas, np.int64), np.asarray(totals, np.int64)
    out = np.zeros((len(quotas), len(totals)), np.int64)

    def split(vector: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = vector
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        draws, rest = int(totals[lo:mid].sum()), int(vector.sum())
        left = np.zeros_like(vector)
        for i, n in enumerate(vector.tolist()):  # the draw of one row given those before it is an ordinary hypergeometric draw
            rest -= n
            left[i] = rng.hypergeometric(n, rest, draws) if draws and n else 0
            draws -= int(left[i])
        split(left, lo, mid)
        split(vector - left, mid, hi)

    if len(quotas):
        split(quotas, 0, len(totals))
    return out


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """``sid, upto``: for every source of ``quotas`` (``sid, quota``) its blocks in the shards up to each one, by the splitting tree."""
    spark = quotas.sparkSession
    grouped = quotas.withColumn("part", F.floor(F.col("sid") / group_sources))
    parts = grouped.groupBy("part").agg(F.sum("quota").alias("quota")).orderBy("part").collect()  # a row for each 4,096 sources
    table = splitting_tree([r.quota for r in parts], even_totals(sum(r.quota for r in parts), n_shards), [seed])
    totals = spark.createDataFrame([(r.part, row) for r, row in zip(parts, table.tolist())], "part long, totals array<long>")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        own = splitting_tree(rows["quota"].to_numpy(), np.asarray(rows["totals"].iloc[0]), [seed, int(key[0]) + 1])
        return pd.DataFrame({"sid": rows["sid"].to_numpy(), "upto": list(np.cumsum(own, axis=1))})

    return grouped.join(F.broadcast(totals), "part").groupBy("part").applyInPandas(run, "sid long, upto array<long>")


def allocate(docs: DataFrame, n_shards: int = SHARDS, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """One row per document row: ``row`` (its number), ``doc_id, source, text_hash, size, source_size, target`` and
    ``takes``, an array of ``(pass, shard, words)``, one element for each time the mix takes it."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).substr(1, 16).alias("perm"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"),
    )
    keyed = common.materialize(keyed, "mix-docs")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = source_targets(sizes, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("extra", F.bround("target", 0).cast("long") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("cells", F.greatest(F.lit(1), F.least(F.lit(65536), F.ceil(F.col("rows") / ROWS_PER_CELL))).cast("int"))
    plan = common.materialize(plan.select("sid", F.col("source").alias("source_name"), "source_size", "target", "passes", "extra", "cells"), "mix-targets")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(MIN_BLOCK_WORDS, -(-total // MAX_BLOCKS))

    d = keyed.join(common.broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    d = d.withColumn("cell", F.floor(F.conv(F.substring("perm", 1, 4), 16, 10).cast("long") * F.col("cells") / 65536).cast("int"))
    cells = d.groupBy("sid", "cell").agg(F.sum("size").alias("cell_words"))
    cells = cells.select("sid", "cell", (F.sum("cell_words").over(Window.partitionBy("sid").orderBy("cell")) - F.col("cell_words")).alias("cell_start"))
    order = Window.partitionBy("sid", "cell").orderBy("perm", F.col("doc_id").asc_nulls_last(), "size", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(order)).join(cells, ["sid", "cell"])
    d = d.withColumn("start", F.col("cell_start") + F.col("upto") - F.col("size")).withColumn("block", F.floor(F.col("start") / block_words))
    d = common.materialize(d.drop("cells", "upto", "cell_start", "cell", "perm"), "mix-blocks")
    common.discard(keyed)

    # one row per block, at most MAX_BLOCKS and one per source; their prefix sums go by cells of the block key as well
    blocks = d.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.min("start").alias("block_start"), F.first("passes").alias("n_passes"), F.first("extra").alias("extra_words"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}b"), F.col("sid").cast("string"), F.col("block").cast("string")))
    blocks = common.materialize(blocks.withColumn("block_key", key).withColumn("cell", F.substring("block_key", 1, 2)), "mix-block-list")
    cells = blocks.groupBy("sid", "cell").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))  # at most 256 a source
    upto = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("sid", "cell", (F.sum("w").over(upto) - F.col("w")).alias("cell_before"), (F.sum("n").over(upto) - F.col("n")).alias("cell_rank"))
    permuted = Window.partitionBy("sid", "cell").orderBy("block_key", "block")
    blocks = blocks.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    blocks = blocks.join(cells, ["sid", "cell"]).withColumn("rank", F.col("rank") + F.col("cell_rank")).withColumn("before", F.col("before") + F.col("cell_before"))
    blocks = blocks.withColumn("drawn", F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), F.col("extra_words") - F.col("before"))))
    counts = blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("n_blocks"), F.first("n_passes").alias("p"), F.count_if(F.col("before") < F.col("extra_words")).alias("m"))
    counts = common.materialize(counts.select("sid", "n_blocks", (F.col("p") * F.col("n_blocks") + F.col("m")).alias("quota")), "mix-quotas")
    tree = counts.select("sid", "n_blocks").join(shard_quotas(counts, n_shards, seed, group_sources), "sid")
    blocks = blocks.join(tree, "sid")

    def instance(p, drawn):
        nth = p.cast("long") * F.col("n_blocks") + F.col("rank")
        return F.struct(p.cast("int").alias("pass"), F.size(F.filter("upto", lambda x: x <= nth)).alias("shard"), drawn.alias("drawn"))

    whole = F.transform(F.sequence(F.lit(0), F.col("n_passes") - 1), lambda p: instance(p, F.col("words")))
    whole = F.when(F.col("n_passes") > 0, whole).otherwise(F.slice(whole, 1, 0))
    last = F.array(instance(F.col("n_passes"), F.col("drawn")))
    takes = F.when(F.col("drawn") > 0, F.concat(whole, last)).otherwise(whole)
    d = d.join(blocks.select("sid", "block", "block_start", takes.alias("insts")), ["sid", "block"])
    words = lambda x: F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), x["drawn"] - (F.col("start") - F.col("block_start"))))
    each = F.transform("insts", lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), words(x).alias("words")))
    return d.select("row", "doc_id", "text_hash", "source", "size", "source_size", "target", F.filter(each, lambda x: x["words"] > 0).alias("takes"))


def mix(docs: DataFrame, seed: int = 17, **params) -> tuple[DataFrame, DataFrame]:
    """(``row, doc_id, text_hash, source, size, source_size, target`` of every document row; the mixture, read back from the shards).

    The mixture has a row for each time a document is taken, ``row, doc_id, text_hash, source, size, pass, words, shuffle_key,
    shard``, in files partitioned by ``shard`` and sorted by ``shuffle_key``: the key is a hash, so the order within a shard is a
    local shuffle and no shard needs another's rows. ``words`` < size marks the document that a quota ends in.
    """
    spark = docs.sparkSession
    planned = common.materialize(allocate(docs, seed=seed, **params), "mix-plan")
    taken = planned.select("row", "doc_id", "text_hash", "source", "size", F.explode("takes").alias("t")).select("row", "doc_id", "text_hash", "source", "size", "t.*")
    taken = taken.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "shard", "row", "doc_id", "pass"))
    columns = ["row", "doc_id", "text_hash", "source", "size", "pass", "words", "shuffle_key", "shard"]
    ordered = taken.select(*columns).repartitionByRange(common.shuffle_partitions(spark), "shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")
    return planned.drop("takes"), common.materialize(ordered, "mix-shards", partition_by="shard")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: how many words of each document the mix of all documents takes, counted over the shards written."""
    planned, mixture = mix(common.read(spark, sf_dir, "documents"))
    taken = mixture.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).cast("int").alias("n_takes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return planned.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", zero("taken").cast("long").alias("taken"), zero("n_takes").cast("int").alias("n_takes"))


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size,
         substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) as perm
  from documents
), s as (
  select source, sum(size)::BIGINT as source_size, row_number() over (order by source nulls last) - 1 as sid from d group by source
), w as (
  select *, 2::DOUBLE * source_size as cap, (case sid % 3 when 0 then 3 when 1 then 1 else 2 end)::DOUBLE as weight,
         1.5::DOUBLE * (sum(source_size) over ())::DOUBLE as budget from s
), r as (
  select *, cap / weight as ratio,
         (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w
), t as (
  select *, sum(case when level >= ratio then cap else 0 end) over () as cap_sum,
         sum(case when level >= ratio then 0 else weight end) over () as open_weight from r
), p as (
  select source, sid, source_size, case when level >= ratio then cap else (budget - cap_sum) * weight / open_weight end as target from t
), q as (
  select *, case when source_size = 0 then 0 else floor(target / source_size)::BIGINT end as passes, greatest(1024, ceil((sum(source_size) over ()) / 200000))::BIGINT as block_words from p
), e as (
  select d.doc_id, d.size, q.*, round_even(target, 0)::BIGINT - passes * source_size as extra,
         sum(d.size) over (partition by q.sid order by perm, doc_id nulls last rows between unbounded preceding and current row) - d.size as start
  from d join q on d.source is not distinct from q.source
), f as (select *, (start // block_words)::BIGINT as block from e),
b as (
  select sid, block, sum(size) as words, min(start) as block_start, md5('17b|' || sid || '|' || block) as block_key from f group by sid, block
), c as (
  select *, sum(words) over (partition by sid order by block_key, block rows between unbounded preceding and current row) - words as before from b
)
select f.doc_id, f.size, f.source_size, f.target,
       (f.passes * f.size + least(f.size, greatest(0, least(c.words, greatest(0, f.extra - c.before)) - (f.start - c.block_start))))::BIGINT as taken,
       ((case when f.size > 0 then f.passes else 0 end)
        + (case when least(f.size, greatest(0, least(c.words, greatest(0, f.extra - c.before)) - (f.start - c.block_start))) > 0 then 1 else 0 end))::INTEGER as n_takes
from f join c on f.sid = c.sid and f.block = c.block
"""
