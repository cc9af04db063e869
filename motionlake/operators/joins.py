"""Joins that a time axis needs: band, interval, as-of, nearest and bracketing joins, always on an equi-key.

A condition like ``|a.frame - b.frame| <= k`` alone would become a nested loop. Here one side is listed under the width-k
buckets it can meet (at most three), so the physical join is a hash or merge join on (keys, bucket).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

Names = list[str]


def _bucketed(df: DataFrame, column: str, width: float, around: bool) -> DataFrame:
    at = F.floor(F.col(column) / width)
    return df.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1))) if around else df.withColumn("_bucket", at)


def band_semi(left: DataFrame, right: DataFrame, keys: Names, left_at: str, right_at: str, width: float) -> DataFrame:
    """Rows of ``left`` with some row of ``right`` at most ``width`` away."""
    return _band(left, right, keys, left_at, right_at, width, "left_semi")


def band_anti(left: DataFrame, right: DataFrame, keys: Names, left_at: str, right_at: str, width: float) -> DataFrame:
    """Rows of ``left`` without any row of ``right`` at most ``width`` away."""
    return _band(left, right, keys, left_at, right_at, width, "left_anti")


def _band(left: DataFrame, right: DataFrame, keys: Names, left_at: str, right_at: str, width: float, how: str) -> DataFrame:
    r = _bucketed(right.select(*keys, F.col(right_at).alias("_r")).distinct(), "_r", width, True).withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumnRenamed("_bucket", "_r_bucket")
    same = (F.col("_bucket") == F.col("_r_bucket")) & (F.abs(F.col(left_at) - F.col("_r")) <= width)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return _bucketed(left, left_at, width, False).join(r, same, how).drop("_bucket")


def interval_join(points: DataFrame, spans: DataFrame, keys: Names, at: str, start: str, end: str, width: float, closed: bool = True) -> DataFrame:
    """Every pair of a point and a span that holds it. Spans are listed under each width-``width`` bucket they touch."""
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return p.join(s, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def asof_forward(left: DataFrame, right: DataFrame, keys: Names, left_at: str, right_at: str, within: float | None, out: str, payload: Names = ()) -> DataFrame:
    """For each left row the first right row strictly after it (and at most ``within`` after): ``out`` and ``payload``, or NULLs.

    One union and one backward window: linear in both sides, whatever the number of right rows per left row."""
    names = [c for c in left.columns]
    l = left.select(F.struct(*names).alias("_l"), *keys, F.col(left_at).cast("double").alias("_at"), F.lit(1).alias("_side"))
    value = F.struct(F.col(right_at).alias(out), *payload)
    r = right.select(*keys, F.col(right_at).cast("double").alias("_at"), F.lit(0).alias("_side"), value.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    # backward in time; at equal times the right rows come after the left rows, so they are not yet seen
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_next", F.last("_r", True).over(w)).filter("_side = 1")
    near = F.lit(True) if within is None else F.col(f"_next.{out}") - F.col("_at") <= within
    return both.select("_l.*", *[F.when(near, F.col(f"_next.{c}")).alias(c) for c in (out, *payload)])


def nearest(left: DataFrame, right: DataFrame, on: Names, distance: Column, keep: Names, id_columns: Names, out: str = "distance", limit: Column | None = None) -> DataFrame:
    """For each left row (``id_columns``) the right row of the same ``on`` keys with the smallest distance; ties to the smaller ``keep``."""
    pairs = left.join(right, on).withColumn(out, distance)
    if limit is not None:
        pairs = pairs.filter(F.col(out) <= limit)
    best = F.min(F.struct(out, *keep)).alias("_b")
    return pairs.groupBy(*on, *id_columns).agg(best).select(*on, *id_columns, "_b.*")


def densify(df: DataFrame, keys: Names, frame: str, start: Column | None = None) -> DataFrame:
    """A row for every frame from 0 (or ``start``) to the key's last; missing ones have NULLs."""
    first = F.lit(0) if start is None else start
    spine = df.groupBy(*keys).agg(F.max(frame).alias("_last"), F.min(frame).alias("_first"))
    spine = spine.select(*keys, F.explode(F.sequence(first.cast("int"), F.col("_last").cast("int"))).alias(frame))
    return spine.join(df.withColumn(frame, F.col(frame).cast("int")), [*keys, frame], "left")


def match_path_or_stem(labels: DataFrame, found: DataFrame, path: str, payload: Names) -> DataFrame:
    """Labels with the prediction of the same path, else with that of the same file stem if the stem is unique."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?$", 1)
    exact = found.select(path, F.struct(*payload).alias("_exact"))
    unique = found.withColumn("_stem", stem(path)).groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*payload)).alias("_by_stem")).filter("_n = 1").drop("_n")
    joined = labels.withColumn("_stem", stem(path)).join(exact, path, "left").join(unique, "_stem", "left")
    chosen = F.coalesce("_exact", "_by_stem")
    return joined.select(*labels.columns, *[chosen[p].alias(p) for p in payload])


def first_two(df: DataFrame, keys: Names, order: Names, values: Names) -> DataFrame:
    """The first two rows of each key side by side: ``<value>_a, <value>_b``; keys with one row give none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    pick = lambda v, n: F.max(F.when(F.col("_n") == n, F.struct(v)))[v].alias(f"{v}_{'ab'[n - 1]}")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *[pick(v, n) for v in values for n in (1, 2)]).filter("_c = 2").drop("_c")


def fragment_pairs(fragments: DataFrame, keys: Names, fps: float, height: float, longest_s: float = 60.0, reach: float = 0.7) -> DataFrame:
    """Ordered pairs of track fragments that may be one person by time and place: the second starts within ``longest_s`` after the
    first ends, nearer than ``reach`` of the picture's height. ``fragments``: keys, track_id, first, last, cx0, cy0 (start), cx1, cy1
    (end). ``score``: distance plus that reach in proportion to the pause. Starts meet ends by buckets of time and place."""
    gap, far = int(fps * longest_s), reach * height
    cell = lambda c: F.floor(F.col(c) / far)
    around = lambda c: F.array(cell(c) - 1, cell(c), cell(c) + 1)
    at = F.floor(F.col("last") / gap)
    a = fragments.select(*keys, F.col("track_id").alias("a"), "last", "cx1", "cy1", F.explode(F.array(at, at + 1)).alias("_t"))
    a = a.withColumn("_x", F.explode(around("cx1"))).withColumn("_y", F.explode(around("cy1")))
    b = fragments.select(*keys, F.col("track_id").alias("b"), "first", "cx0", "cy0", F.floor(F.col("first") / gap).alias("_t"), cell("cx0").alias("_x"), cell("cy0").alias("_y"))
    pause = F.col("first") - F.col("last")
    dist = F.sqrt((F.col("cx1") - F.col("cx0")) ** 2 + (F.col("cy1") - F.col("cy0")) ** 2)
    rows = a.join(b, [*keys, "_t", "_x", "_y"]).filter((F.col("a") != F.col("b")) & (pause > 0) & (pause < gap) & (dist < far))
    return rows.select(*keys, "a", "b", (pause / fps).alias("gap_s"), (dist + pause * (far / gap)).alias("score"))


def pairs_of_key(rows: DataFrame, keys: Names, number: str, parts: int = 16) -> DataFrame:
    """Every two rows of one key: the columns of the one with the smaller ``number`` end in ``_a``, the other's in ``_b``. Few keys
    may hold all rows, so a key's second rows are dealt over ``parts``, each with a copy of its first rows."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in keys]
    first = rows.select(*keys, *side("a")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    second = rows.select(*keys, F.pmod(F.xxhash64(number), F.lit(parts)).cast("int").alias("_part"), *side("b"))
    return first.join(second, [*keys, "_part"]).filter(F.col(f"{number}_a") < F.col(f"{number}_b")).drop("_part")


#: Tracks of a block; two blocks meet in one task, as two matrices of tracks and frames, a strip of rows and of frames at a time.
BLOCK, STRIP, FRAMES = 2048, 256, 4096


def _meet(rows: list[tuple], near: float, most: float, same: bool) -> tuple[np.ndarray, ...]:
    """a, b, distance, overlap of the pairs of two blocks (or within one): ``rows`` holds for each side ids, cx, cy, lengths and frames."""
    (ids, cx, cy, n, f), (other, ox, oy, m, g) = rows
    out = []
    for lo in range(0, len(ids), STRIP):
        s = slice(lo, lo + STRIP)
        d = np.sqrt((cx[s, None] - ox) ** 2 + (cy[s, None] - oy) ** 2)
        r, c = np.nonzero((d < near) & (ids[s, None] < other) if same else d < near)
        if not len(r):
            continue
        ends = np.concatenate([[0], np.cumsum(n)])
        own, at = np.repeat(np.arange(len(ids[s])), n[s]), f[ends[lo] : ends[min(lo + STRIP, len(n))]]
        whose = np.repeat(np.arange(len(other)), m)
        shared = np.zeros(d.shape, np.float64)
        frames = np.unique(at)
        for k in range(0, len(frames), FRAMES):
            part = frames[k : k + FRAMES]
            sides = []
            for size, who, when in ((d.shape[0], own, at), (d.shape[1], whose, g)):
                place = np.minimum(np.searchsorted(part, when), len(part) - 1)
                held = part[place] == when
                side = np.zeros((size, len(part)), np.float32)
                side[who[held], place[held]] = 1
                sides.append(side)
            shared += sides[0] @ sides[1].T
        share = shared[r, c] / np.minimum(n[s][r], m[c])
        r, c, share = r[share <= most], c[share <= most], share[share <= most]
        a, b = ids[s][r], other[c]
        out.append((np.minimum(a, b), np.maximum(a, b), d[r, c], share))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0], cx[:0], cx[:0])


def overlap_pairs(obs: DataFrame, keys: Names, near: float, most: float) -> DataFrame:
    """Pairs of fragments with mean centres nearer than ``near`` and at most ``most`` of the smaller's frames in common. Every two blocks of a key's
    fragments meet once; the frames in common of all their pairs are one product of matrices."""
    means = obs.filter(F.col("track_id").isNotNull()).dropna(subset=keys).groupBy(*keys, "track_id").agg(F.collect_set("frame").alias("f"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
    means = stored(means, "means")
    parts = -(-(means.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1) // BLOCK)
    own, other = F.pmod(F.xxhash64("track_id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = means.withColumn("_p", own).withColumn("_q", other).withColumns({"_i": F.least("_p", "_q"), "_j": F.greatest("_p", "_q")}).drop("_q")

    def meet(table: pa.Table) -> pa.Table:
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        sides = []
        for p in (i, j):
            t = table.filter(pc.equal(table["_p"], p)).combine_chunks()
            sides.append((t["track_id"].to_numpy(), *(t[c].cast(pa.float64()).to_numpy() for c in ("cx", "cy")), pc.list_value_length(t["f"]).to_numpy(), pc.list_flatten(t["f"]).to_numpy()))
        a, b, d, share = _meet(sides, near, most, i == j)
        first = pa.array(np.zeros(len(a), np.int64))
        return pa.table({**{k: table[k].take(first) for k in keys}, "a": a, "b": b, "distance": d, "overlap": share})

    types = {f.name: f.dataType.simpleString() for f in means.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"a {types['track_id']}", f"b {types['track_id']}", "distance double", "overlap double"])
    return dealt.groupBy(*keys, "_i", "_j").applyInArrow(meet, schema)
