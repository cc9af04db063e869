"""Sharding by sampled splitters.

The key of a record is (hash of its text, record id and place in the table), so equal texts are neighbours. Groups of equal texts larger than
two fine ranges are set aside (fewer of them than ranges, so their list is bounded) and subdivided by record id and place. The other records are cut into
fine ranges by the quantiles of a size-weighted key sample; ranges that came out overfull are subdivided. The exact
bytes of each range, counted over all records, then decide which ranges fill which shard. A set-aside group goes whole
to the emptiest shard; one larger than a shard is poured into several.

Defined results: a null text counts 0 bytes, its checksum is that of no bytes; a null ``doc_id`` is an ordinary record; repeated rows are
separate records, told apart by their place in the stored table, so that a group of them can be cut like any other; an empty table
gives an empty result. The sample is a hash of the record, and reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROW_OVERHEAD = 8
#: A set-aside group may overfill a shard by this part of it.
SLACK = 1 / 50
SAMPLE_PER_RANGE = 8
MAX_RANGES = 20_000
RANGE_ROWS = 500_000
MIN_RANGES = 600
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _split_points(sample: list[int], n: int) -> list[int]:
    """Quantile boundaries of the sample, strictly increasing."""
    sample = sorted(sample)
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 5) -> DataFrame:
    """One row per record: ``doc_id, size, text_crc32, shard, slot``; bytes near equal, slots gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = common.materialize(docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()).alias("u")), "shard-keys")
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    goal = total / n_shards

    # groups of equal texts larger than two ranges: at most half as many as ranges
    n_ranges = min(MAX_RANGES, max(MIN_RANGES, -(-rows // RANGE_ROWS)))
    heavy = keyed.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter(F.col("bytes") > 2 * total / n_ranges).collect()
    heavy_cells = {r.h: max(1, min(MAX_RANGES, -(-r.bytes * n_ranges // total))) for r in heavy}
    first_cell, cell = {}, 0
    for h in sorted(heavy_cells):
        first_cell[h] = cell
        cell += heavy_cells[h]
    heavy_df = F.broadcast(spark.createDataFrame([(h, first_cell[h], heavy_cells[h]) for h in first_cell], "heavy_h long, first_cell int, parts int"))

    light_bytes = total - sum(r.bytes for r in heavy)
    light = keyed.join(heavy_df, keyed.h == F.col("heavy_h"), "left_anti")
    chance = F.col("size") * (n_ranges * SAMPLE_PER_RANGE / max(1, light_bytes))
    unit = (F.xxhash64(F.lit(seed + 1), "h", "doc_id") / F.lit(float(1 << 64))) + 0.5
    sample = [r.h for r in light.filter(unit < chance).select("h").collect()]
    bounds = _split_points(sample, n_ranges)
    ranges = _Ranges(spark, bounds)
    counted = {r.r: r for r in ranges.assign(light, "h").groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    most = 2 * light_bytes / max(1, len(bounds) + 1)
    edges = [LOW, *bounds, HIGH]
    more = []
    for i in range(len(bounds) + 1):  # an overfull range is cut at equal distances: keys are hashes, spread evenly inside it
        if i in counted and counted[i].bytes > most:
            parts, width = int(counted[i].bytes // (most / 2)) + 1, edges[i + 1] - edges[i]
            more += [edges[i] + width * k // parts for k in range(1, parts)]
    ranges = _Ranges(spark, sorted({*bounds, *more}), offset=cell)

    celled = keyed.join(heavy_df, keyed.h == F.col("heavy_h"), "left")
    celled = ranges.assign(celled, "h")
    in_heavy = F.col("heavy_h").isNotNull()
    celled = celled.select(
        "doc_id", "size", "text_crc32",
        F.when(in_heavy, F.col("first_cell") + F.pmod(F.col("u"), F.col("parts")).cast("int")).otherwise(F.col("r")).alias("cell"),
        F.when(in_heavy, F.col("u")).otherwise(F.col("h")).alias("k"),
    )
    peers = Window.partitionBy("cell").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    place = Window.partitionBy("cell").orderBy("k", F.col("doc_id").asc_nulls_last(), "text_crc32")
    placed = celled.withColumn("upto", F.sum("size").over(peers)).withColumn("n", F.row_number().over(place).cast("long"))
    placed = common.materialize(placed, "shard-cells")
    bytes_of = {r.cell: r.bytes for r in placed.groupBy("cell").agg(F.max("upto").alias("bytes")).collect()}

    pieces = _fill(bytes_of, heavy_cells, first_cell, cell, goal, n_shards)
    layout = F.broadcast(spark.createDataFrame(sorted(pieces.items()), "cell int, pieces array<struct<upto:double,shard:int>>"))
    placed = placed.join(layout, "cell")
    own = F.filter("pieces", lambda p: p["upto"] >= F.col("upto"))
    placed = placed.withColumn("shard", F.element_at(own, 1)["shard"]).drop("pieces", "upto")
    # a row for each cell and shard that meet: at most the cells and one more per shard
    spans = placed.groupBy("cell", "shard").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    spans = spans.withColumn("base", F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows"))
    out = placed.join(F.broadcast(spans.select("cell", "shard", "first", "base")), ["cell", "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("n") - F.col("first") + F.col("base")).alias("slot"))


class _Ranges:
    """Maps a 64-bit key to its range by a broadcast of the boundaries (at most MAX_RANGES and their subdivisions)."""

    def __init__(self, spark, bounds: list[int], offset: int = 0):
        # a range is listed under every value of the key's top bits it touches, so a record meets a few rows by an equi-join
        rows, shift, edges = [], 52, [LOW, *bounds, HIGH]
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            last = i == len(edges) - 2
            for top in range(lo >> shift, ((hi if last else hi - 1) >> shift) + 1):
                rows.append((top, lo, hi, last, i + offset))
        self.df, self.shift = spark.createDataFrame(rows, "top long, lo long, hi long, last boolean, r int"), shift

    def assign(self, df: DataFrame, key: str) -> DataFrame:
        k = F.col(key)
        inside = (k >= F.col("lo")) & ((k < F.col("hi")) | F.col("last"))
        return df.join(F.broadcast(self.df), (F.shiftright(k, self.shift) == F.col("top")) & inside).drop("top", "lo", "hi", "last")


def _fill(bytes_of: dict, heavy_cells: dict, first_cell: dict, n_heavy: int, goal: float, n_shards: int) -> dict:
    """cell -> [(bytes of the cell up to which, shard)]. Set-aside groups first, largest first, then the ranges in key order."""
    load, pieces = [0.0] * n_shards, {}
    groups = sorted(heavy_cells, key=lambda h: (-sum(bytes_of.get(first_cell[h] + i, 0) for i in range(heavy_cells[h])), h))
    for h in groups:
        cells = [c for c in range(first_cell[h], first_cell[h] + heavy_cells[h]) if c in bytes_of]
        size = sum(bytes_of[c] for c in cells)
        emptiest = min(range(n_shards), key=lambda s: (load[s], s))
        if load[emptiest] + size <= goal * (1 + SLACK):
            for c in cells:
                pieces[c] = [(float("inf"), emptiest)]
            load[emptiest] += size
        else:
            _pour(cells, bytes_of, load, goal, pieces, n_shards)
    _pour(sorted(c for c in bytes_of if c >= n_heavy), bytes_of, load, goal, pieces, n_shards)
    return pieces


def _pour(cells: list, bytes_of: dict, load: list, goal: float, pieces: dict, n_shards: int) -> None:
    """Fills the room that shards have left, in order, cutting a cell where a shard is full."""
    order = sorted(range(n_shards), key=lambda s: (load[s] > 0, s))
    at = 0
    for c in cells:
        done, own = 0.0, []
        while True:
            while at < n_shards - 1 and goal - load[order[at]] < 0.5:
                at += 1
            room = goal - load[order[at]]
            left = bytes_of[c] - done
            if left <= room or at == n_shards - 1:
                own.append((float("inf"), order[at]))
                load[order[at]] += left
                break
            done += room
            load[order[at]] = goal
            own.append((done, order[at]))
        pieces[c] = own


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents in shards 0 to 23, bytes near equal."""
    s = shard(common.read(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
