"""Track clean-up: filters, box merging, matching, clustering and stitching of fragments.

The heavy part, observations to one row per fragment or pair, is grouped and joined by Spark. Passes whose result depends on
the order of frames are streams over islands of a clip; passes over the few fragments of a clip run per clip in Python.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import joins, scan

CLIP = ["clip_id"]


def moving_tracks(obs: DataFrame, height: float, least_frames: int = 10, least_share: float = 0.01) -> DataFrame:
    """Tracks of enough frames whose centre height varies by a share of the picture height."""
    t = obs.groupBy(*CLIP, "track_id").agg(F.count(F.lit(1)).alias("frames"), F.stddev_pop("cy").alias("sd_y"))
    return t.filter((F.col("frames") >= least_frames) & (F.col("sd_y") >= least_share * height))


def tall_or_moving_tracks(obs: DataFrame, width: float, height: float, least_frames: int = 5) -> DataFrame:
    """Tracks of enough frames that are tall or move; all tracks of a clip where none passes."""
    t = obs.groupBy(*CLIP, "track_id").agg(F.count(F.lit(1)).alias("frames"), F.avg("h").alias("mean_h"), F.stddev_pop("cx").alias("sd_x"), F.stddev_pop("cy").alias("sd_y"))
    ok = (F.col("frames") >= least_frames) & ((F.col("mean_h") > 0.15 * height) | (F.col("sd_x") >= 0.02 * width) | (F.col("sd_y") >= 0.02 * height))
    t = t.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(Window.partitionBy(*CLIP)))
    return t.filter(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def roles(obs: DataFrame) -> DataFrame:
    """near, far and other by the rank of the median box height."""
    m = obs.groupBy(*CLIP, "track_id").agg(F.median("h").alias("median_h"), F.count(F.lit(1)).alias("frames"))
    rank = F.row_number().over(Window.partitionBy(*CLIP).orderBy(F.desc("median_h"), "track_id"))
    return m.withColumn("_r", rank).withColumn("role", F.when(F.col("_r") == 1, "near").when(F.col("_r") == 2, "far").otherwise("other")).drop("_r")


def track_summary(obs: DataFrame) -> DataFrame:
    """Frames seen, their share of the clip's frames and the mean visibility where seen."""
    clip = obs.groupBy(*CLIP).agg((F.max("frame") - F.min("frame") + 1).alias("_all"))
    t = obs.groupBy(*CLIP, "track_id").agg(F.countDistinct("frame").alias("frames"), F.avg("vis").alias("mean_visibility"))
    return t.join(clip, CLIP).select(*CLIP, "track_id", "frames", (F.col("frames") / F.col("_all")).alias("coverage"), "mean_visibility")


def stationary_bins(obs: DataFrame, cell: float = 20.0, least_span: int = 15, least_count: float = 7.5) -> DataFrame:
    """Grid cells in which detections stay: from first to last frame long, and many."""
    c = obs.groupBy(*CLIP, F.floor(F.col("cx") / cell).alias("gx"), F.floor(F.col("cy") / cell).alias("gy")).agg((F.max("frame") - F.min("frame") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    return c.filter((F.col("span") >= least_span) & (F.col("n") >= least_count))


def drop_stationary(obs: DataFrame, cell: float = 20.0, least_span: int = 15, least_count: float = 7.5) -> DataFrame:
    """Observations outside the stationary cells: the variant for any number of detections."""
    rows = obs.withColumn("gx", F.floor(F.col("cx") / cell)).withColumn("gy", F.floor(F.col("cy") / cell))
    return rows.join(stationary_bins(obs, cell, least_span, least_count), [*CLIP, "gx", "gy"], "left_anti").drop("gx", "gy")


class Leaders:
    """Leader clustering with running means: a point joins the oldest cluster whose mean is nearer than ``reach``, else it leads a new one.
    Clusters are found by the cell of their mean, so a point looks at nine cells."""

    def __init__(self, reach: float):
        self.reach, self.sums, self.cells = reach, [], {}

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return int(x // self.reach), int(y // self.reach)

    def row(self, frame, box, x, y):
        gx, gy = self._cell(x, y)
        near = (c for i in (-1, 0, 1) for j in (-1, 0, 1) for c in self.cells.get((gx + i, gy + j), ()))
        c = min((c for c in near if math.hypot(x - self.sums[c][0] / self.sums[c][2], y - self.sums[c][1] / self.sums[c][2]) < self.reach), default=None)
        if c is None:
            c = len(self.sums)
            self.sums.append([x, y, 1])
            self.cells.setdefault((gx, gy), set()).add(c)
        else:
            s = self.sums[c]
            old = self._cell(s[0] / s[2], s[1] / s[2])
            s[0], s[1], s[2] = s[0] + x, s[1] + y, s[2] + 1
            new = self._cell(s[0] / s[2], s[1] / s[2])
            if new != old:
                self.cells[old].discard(c)
                self.cells.setdefault(new, set()).add(c)
        yield frame, box, c

    def end(self):
        return ()


def leader_clusters(obs: DataFrame, reach: float = 20.0) -> DataFrame:
    """``clip_id, frame, box_idx, cluster``: detections of a clip in the order of frame and box, clustered as ``Leaders`` says."""
    kind = obs.schema["box_idx"].dataType.simpleString()
    return scan.scan(obs, CLIP, ["frame", "box_idx"], ["frame", "box_idx", "cx", "cy"], lambda: Leaders(reach), f"frame int, box_idx {kind}, cluster int")


def drop_stationary_exact(obs: DataFrame, reach: float = 20.0, least_span: int = 15, least_count: float = 7.5) -> DataFrame:
    """Observations outside the clusters that stay. The clusters depend on the order of a clip's detections, so a clip is one
    stream (its clusters in memory, not its rows); ``drop_stationary`` is the variant without an order."""
    c = leader_clusters(obs, reach)
    stay = c.groupBy(*CLIP, "cluster").agg((F.max("frame") - F.min("frame") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    stay = stay.filter((F.col("span") >= least_span) & (F.col("n") >= least_count)).select(*CLIP, "cluster")
    return obs.join(c.join(stay, [*CLIP, "cluster"]).select(*CLIP, "frame", "box_idx"), [*CLIP, "frame", "box_idx"], "left_anti")


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of a frame that belong to one person (overlap in x, vertical gap up to 30 % of the smaller height) become their
    union, again until nothing merges. ``boxes``: clip_id, frame, box_idx, x, y, w, h. """

    def merged(left: list[tuple]) -> list[tuple]:
        again = True
        while again:
            again = False
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    (ax, ay, aw, ah), (bx, by, bw, bh) = left[i], left[j]
                    gap = max(ay, by) - min(ay + ah, by + bh)
                    if not again and min(ax + aw, bx + bw) > max(ax, bx) and gap <= 0.3 * min(ah, bh):
                        x, y = min(ax, bx), min(ay, by)
                        left[i] = (x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y)
                        del left[j]
                        again = True
                        break
                if again:
                    break
        return left

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for frame, g in pdf.sort_values(["frame", "box_idx"]).groupby("frame"):
            rows += [(pdf["clip_id"].iloc[0], frame, i, *map(float, b)) for i, b in enumerate(merged(list(g[["x", "y", "w", "h"]].itertuples(index=False, name=None))))]
        return pd.DataFrame(rows, columns=["clip_id", "frame", "box_idx", "x", "y", "w", "h"])

    kind = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    # some frames to a group: the groups stay bounded however long a clip is
    return boxes.groupBy("clip_id", F.floor(F.col("frame") / 256)).applyInPandas(run, f"clip_id {kind['clip_id']}, frame {kind['frame']}, box_idx int, x double, y double, w double, h double")


def box_components(boxes: DataFrame) -> DataFrame:
    """One-pass variant of ``merge_boxes`` in SQL terms: boxes sorted by x, a new group where a box starts right of all before it."""
    w = Window.partitionBy("clip_id", "frame").orderBy("x", "box_key")
    reach = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("_new", F.coalesce((F.col("x") >= reach).cast("int"), F.lit(0))).withColumn("group", F.sum("_new").over(w))
    return rows.groupBy("clip_id", "frame", "group").agg(F.count(F.lit(1)).alias("boxes"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def shape_filter(boxes: DataFrame, least_area: float = 400.0, least_ratio: float = 0.6) -> DataFrame:
    return boxes.filter((F.col("w") * F.col("h") >= least_area) & (F.col("h") >= least_ratio * F.col("w")))


def match_tracks(boxes: DataFrame, width: float, share: float = 0.12, patience: int = 15, chunk: int = scan.CHUNK) -> DataFrame:
    """Boxes to tracks, frame by frame: nearest pairs first within ``share`` of the width; an unmatched box starts a track,
    a track unseen for ``patience`` frames ends. ``boxes``: clip_id, frame, box_idx, cx, cy. Adds ``track_id`` (from 0 per clip).

    No track outlives a pause of more than ``patience`` frames, so a clip falls into islands that are matched in parallel, each
    as a stream with its open tracks as state; ids are numbered on from island to island. A clip without pauses is one stream."""
    rows = scan.islands(boxes.select(*CLIP, "frame", "box_idx", "cx", "cy"), CLIP, "frame", "box_idx", patience, "island", chunk)
    local = scan.scan(rows, [*CLIP, "island"], ["frame", "box_idx"], ["frame", "box_idx", "cx", "cy"], lambda: _Tracks(width * share, patience), "frame int, box_idx long, track_id int, cx double, cy double")
    local = stored(local, "tracks")
    counts = local.groupBy(*CLIP, "island").agg((F.max("track_id") + 1).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*CLIP).orderBy("island")) - F.col("_n")).select(F.col("clip_id").alias("_k_clip_id"), F.col("island").alias("_k_island"), "_before")
    same = F.col("clip_id").eqNullSafe(F.col("_k_clip_id")) & (F.col("island") == F.col("_k_island"))
    return local.join(before, same).select(*CLIP, "frame", "box_idx", (F.col("track_id") + F.col("_before")).cast("int").alias("track_id"), "cx", "cy")


class _Tracks(scan.ByFrame):
    def __init__(self, reach: float, patience: int):
        super().__init__()
        self.matcher = Matcher(reach, patience)

    def frame(self, frame, rows):
        return self.matcher.frame(int(frame), rows)


class Matcher:
    """Greedy nearest-first matching with the open tracks as state; used by the batch and by the streaming job."""

    def __init__(self, reach: float, patience: int, tracks: dict | None = None, next_id: int = 0):
        self.reach, self.patience, self.tracks, self.next_id = reach, patience, tracks or {}, next_id

    def frame(self, frame: int, boxes: list[tuple]) -> list[tuple]:
        self.tracks = {t: v for t, v in self.tracks.items() if frame - v[2] <= self.patience}
        pairs = sorted((((cx - v[0]) ** 2 + (cy - v[1]) ** 2) ** 0.5, t, i) for i, (_, cx, cy) in enumerate(boxes) for t, v in self.tracks.items())
        mine, used = {}, set()
        for d, t, i in pairs:
            if d <= self.reach and i not in mine and t not in used:
                mine[i] = t
                used.add(t)
        out = []
        for i, (box, cx, cy) in enumerate(boxes):
            if i not in mine:
                mine[i], self.next_id = self.next_id, self.next_id + 1
            self.tracks[mine[i]] = (cx, cy, frame)
            out.append((frame, int(box), mine[i], float(cx), float(cy)))
        return out


def mutual_nearest(boxes: DataFrame, tracks: DataFrame, reach: float) -> DataFrame:
    """The order-free part of matching: box and track that are each other's nearest in a frame.

    Of boxes or tracks at one place only the smallest can be anyone's nearest. Pairs are not kept or sorted: the least distances are taken
    first, and only pairs at one of them are ranked."""
    frame = ["clip_id", "frame"]
    b = stored(boxes.groupBy(*frame, "cx", "cy").agg(F.min("box_idx").alias("box_idx")), "places")
    t = stored(tracks.groupBy(*frame, "tx", "ty").agg(F.min("track_id").alias("track_id")), "places")
    near = lambda b, t: b.join(t, frame).withColumn("d", F.sqrt((F.col("cx") - F.col("tx")) ** 2 + (F.col("cy") - F.col("ty")) ** 2)).filter(F.col("d") <= reach)
    least = lambda k, out: near(b, t).groupBy(*frame, k).agg(F.min("d").alias(out))
    pairs = near(b.join(least("box_idx", "_db"), [*frame, "box_idx"]), t.join(least("track_id", "_dt"), [*frame, "track_id"])).filter("d = _db or d = _dt")
    by = lambda k, o: F.row_number().over(Window.partitionBy(*frame, k).orderBy("d", o))
    return pairs.withColumn("_b", by("box_idx", "track_id")).withColumn("_t", by("track_id", "box_idx")).filter("_b = 1 and _t = 1").select(*frame, "box_idx", "track_id", "d")


def fragments(obs: DataFrame) -> DataFrame:
    """One row per track: observations, sums of the centre and the frames it is seen in, as runs from first to last."""
    sums = obs.groupBy(*CLIP, "track_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("sx"), F.sum("cy").alias("sy"))
    w = Window.partitionBy(*CLIP, "track_id").orderBy("frame")
    runs = obs.select(*CLIP, "track_id", "frame").distinct().withColumn("_run", F.col("frame") - F.row_number().over(w)).groupBy(*CLIP, "track_id", "_run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return sums.join(runs.groupBy(*CLIP, "track_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs")), [*CLIP, "track_id"])


def _shared(a: list[tuple], b: list[tuple]) -> int:
    """Frames that two lists of runs, in order, have in common."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        n += max(0, min(a[i][1], b[j][1]) - max(a[i][0], b[j][0]) + 1)
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return n


def _union(a: list[tuple], b: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def cluster_fragments(obs: DataFrame, width: float, near: float = 0.15, most_overlap: float = 0.2, keep: int | None = None) -> DataFrame:
    """Fragments of one person: most frames first, each joins the first cluster whose pooled mean centre is nearer than
    ``near`` of the width and with at most ``most_overlap`` of the smaller's frames in common; the ``keep`` largest clusters stay.

    A clip's fragments are one group, each a few sums and its runs of frames: their size follows how often tracking broke, not how long the clip is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        for r in pdf.sort_values(["n", "track_id"], ascending=[False, True]).to_dict("records"):
            own = [(x["a"], x["b"]) for x in r["runs"]]
            size = sum(b - a + 1 for a, b in own)
            for g in groups:
                d = ((r["sx"] / r["n"] - g["sx"] / g["n"]) ** 2 + (r["sy"] / r["n"] - g["sy"] / g["n"]) ** 2) ** 0.5
                if d < near * width and _shared(own, g["runs"]) <= most_overlap * min(size, g["size"]):
                    g["ids"].append(r["track_id"])
                    g["sx"], g["sy"], g["n"], g["runs"] = g["sx"] + r["sx"], g["sy"] + r["sy"], g["n"] + r["n"], _union(g["runs"], own)
                    g["size"] = sum(b - a + 1 for a, b in g["runs"])
                    break
            else:
                groups.append({"ids": [r["track_id"]], "sx": r["sx"], "sy": r["sy"], "n": r["n"], "runs": own, "size": size})
        groups = sorted(groups, key=lambda g: -g["n"])[:keep]
        rows = [(pdf["clip_id"].iloc[0], c, t, p) for c, g in enumerate(groups) for p, t in enumerate(g["ids"])]
        return pd.DataFrame(rows, columns=["clip_id", "cluster", "track_id", "position"])

    kind = {f.name: f.dataType.simpleString() for f in obs.schema.fields}
    return fragments(obs).groupBy("clip_id").applyInPandas(run, f"clip_id {kind['clip_id']}, cluster int, track_id {kind['track_id']}, position int")


def stitch_fragments(obs: DataFrame, fps: float, height: float, longest_s: float = 60.0, least_ratio: float = 0.5, reach: float = 0.7) -> DataFrame:
    """``clip_id, track_id, chain``: track fragments joined end to start, the best-scoring pair of a clip again and again, a joined
    fragment competing with its new median height. ``obs``: clip_id, track_id, frame, cx, cy, h (one box a track and frame).

    Scores do not change when fragments join (``joins.fragment_pairs``: distance and pause between one's end and the
    other's start), only who is alike enough in height. So a pair with no better possible pair at either of its fragments joins at once,
    whatever happens elsewhere; where none is so, the clip's best pair joins. Each round does that for all clips; the
    result is that of joining one pair at a time. ``chain`` is the first fragment's track."""
    key = ["clip_id"]
    at = F.struct("frame", "cx", "cy")
    ends = obs.groupBy(*key, "track_id").agg(F.min(at).alias("s"), F.max(at).alias("e"))
    frag = ends.select(*key, "track_id", F.col("s.frame").alias("first"), F.col("e.frame").alias("last"), F.col("s.cx").alias("cx0"), F.col("s.cy").alias("cy0"), F.col("e.cx").alias("cx1"), F.col("e.cy").alias("cy1"))
    frag = stored(frag, "fragments")
    heights = stored(obs.groupBy(*key, "track_id", "h").agg(F.count(F.lit(1)).alias("n")), "heights")
    edges = stored(joins.fragment_pairs(frag, key, fps, height, longest_s, reach).select(*key, "a", "b", F.struct("score", "a", "b").alias("p")), "pairs")
    chains = frag.select(*key, "track_id", F.col("track_id").alias("chain"))
    while True:
        med = heights.join(chains, [*key, "track_id"]).groupBy(*key, "chain").agg(F.percentile("h", 0.5, F.col("n")).alias("m"))
        of = chains.join(med, [*key, "chain"])
        side = lambda s: of.select(*key, F.col("track_id").alias(s), F.col("chain").alias(f"c_{s}"), F.col("m").alias(f"m_{s}"))  # noqa: E731,B023
        live = edges.join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"])
        live = live.withColumn("ok", F.least("m_a", "m_b") >= least_ratio * F.greatest("m_a", "m_b"))
        live = stored(live, "live")
        ends_of = live.select(*key, F.explode(F.array("c_a", "c_b")).alias("c"), "p").groupBy(*key, "c").agg(F.min("p").alias("least"))
        best = live.filter("ok").groupBy(*key).agg(F.min("p").alias("best"))
        least = lambda s: ends_of.select(*key, F.col("c").alias(f"c_{s}"), F.col("least").alias(f"l_{s}"))  # noqa: E731,B023
        joined = live.filter("ok").join(least("a"), [*key, "c_a"]).join(least("b"), [*key, "c_b"]).join(best, key)
        joined = stored(joined.filter(((F.col("p") == F.col("l_a")) & (F.col("p") == F.col("l_b"))) | (F.col("p") == F.col("best"))).select(*key, "a", "b", "c_a", "c_b"), "joined")
        if not joined.limit(1).count():
            return chains
        renamed = joined.select(*key, F.col("c_b").alias("chain"), F.col("c_a").alias("new"))
        chains = stored(chains.join(renamed, [*key, "chain"], "left").select(*key, "track_id", F.coalesce("new", "chain").alias("chain")), "chains")
        # an end that has a successor, and a start that has a predecessor, are used
        edges = stored(live.select(*key, "a", "b", "p").join(joined.select(*key, "a"), [*key, "a"], "left_anti").join(joined.select(*key, "b"), [*key, "b"], "left_anti"), "pairs")


def one_timeline(obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster and frame; a later fragment of the cluster replaces an earlier one."""
    j = obs.join(clusters, [*CLIP, "track_id"])
    return j.groupBy(*CLIP, "cluster", "frame").agg(F.max_by(F.struct("cx", "cy", "track_id"), "position").alias("p")).select(*CLIP, "cluster", "frame", "p.*")


def sessionise(obs: DataFrame, keys: list[str], frame: str, gap: int) -> DataFrame:
    """Runs of detections with at most ``gap`` frames between: ``first, last, n`` per key and run."""
    w = Window.partitionBy(*keys).orderBy(frame)
    rows = obs.select(*keys, frame).distinct().withColumn("_new", F.coalesce((F.col(frame) - F.lag(frame).over(w) > gap).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_run").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def clean_detections(boxes: DataFrame, fps: float, width: float, height: float, keep: int = 2, smoothing: int = 15) -> DataFrame:
    """Player tracks of a detector's tables: persons that move or are tall, fragments joined end to start, the ``keep`` longest of a clip without
    gaps, their boxes smoothed and cut to whole pixels, with a role by height: clip_id, track_id (the chain), frame, x, y, w, h, role.

    ``boxes``: clip_id, frame, track_id, class, box_idx, x, y, w, h; the first box of a track in a frame counts."""
    from . import series

    people = boxes.filter("class = 'person'").groupBy(*CLIP, "track_id", "frame").agg(*[F.min_by(c, "box_idx").alias(c) for c in ("x", "y", "w", "h")])
    people = stored(people.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2}), "people")
    kept = people.join(tall_or_moving_tracks(people, width, height).select(*CLIP, "track_id"), [*CLIP, "track_id"])
    kept = stored(kept, "kept")
    chains = stitch_fragments(kept, fps, height)
    line = kept.join(chains, [*CLIP, "track_id"]).groupBy(*CLIP, "chain", "frame").agg(*[F.min_by(c, "track_id").alias(c) for c in ("x", "y", "w", "h")])
    line = stored(line.withColumnRenamed("chain", "track_id"), "line")
    n = line.groupBy(*CLIP, "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"), F.max("frame").alias("z"))
    top = n.withColumn("_r", F.row_number().over(Window.partitionBy(*CLIP).orderBy(F.desc("n"), "a", "track_id"))).filter(F.col("_r") <= keep)
    key = [*CLIP, "track_id"]
    spine = top.select(*key, F.explode(F.sequence("a", "z")).alias("frame"))
    rows = spine.join(line, [*key, "frame"], "left")
    for c in ("x", "y", "w", "h"):
        rows = series.savgol(series.fill_gaps(rows, key, ["frame"], c, 1 << 30, f"_{c}"), key, ["frame"], f"_{c}", f"_s{c}", smoothing)
    rows = rows.select(*key, "frame", *[F.col(f"_s{c}").cast("int").alias(c) for c in ("x", "y", "w", "h")])
    role = roles(line.join(top.select(*key), key)).select(*key, "role")
    return rows.join(role, key)


def players_from_boxes(boxes: DataFrame, width: float, height: float, most: int = 4) -> DataFrame:
    """The table part of the multi-player job: split boxes of a frame merged, shapes filtered, matched to tracks, still ones dropped, fragments of one
    person clustered (the ``most`` largest), each cluster one timeline with a role, near first: clip_id, cluster, frame, cx, cy, h, role.

    ``boxes``: clip_id, frame, box_idx, x, y, w, h."""
    whole = stored(shape_filter(merge_boxes(boxes)), "whole")
    placed = whole.select(*CLIP, "frame", F.col("box_idx").cast("long").alias("box_idx"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "h")
    obs = match_tracks(placed, width).join(placed.select(*CLIP, "frame", "box_idx", "h"), [*CLIP, "frame", "box_idx"])
    obs = stored(obs, "observations")
    obs = stored(obs.join(moving_tracks(obs, height).select(*CLIP, "track_id"), [*CLIP, "track_id"]), "moving")
    clusters = stored(cluster_fragments(obs, width, keep=most), "clusters")
    line = one_timeline(obs, clusters).join(obs.select(*CLIP, "track_id", "frame", "h"), [*CLIP, "track_id", "frame"])
    role = roles(line.drop("track_id").withColumnRenamed("cluster", "track_id")).select(*CLIP, F.col("track_id").alias("cluster"), "role")
    return line.join(role, [*CLIP, "cluster"]).select(*CLIP, "cluster", "frame", "cx", "cy", "h", "role")
