"""Hits and bounces from ball, wrist and racket tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import court, fold, joins, scan, series

CLIP = ["clip_id"]
# Thresholds of the hit rules, pixels and frames.
NEAR, PEAK_HALF, MERGE, LEAST_STEP, GATE = 5, 8, 16, 1.5, 200.0
NO_BALL, NO_ANGLE = 9999.0, 1.0
BOUNCE_WITHIN = 45
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def hit_features(at: DataFrame, ball: DataFrame, wrist: DataFrame, racket: DataFrame, half: int = 3) -> DataFrame:
    """Features of candidate frames (clip_id, frame): wrist speed, distances to wrist and racket, ball speed ``half`` frames
    before and after, their change and the cosine between. Unknown: 0, distances 9999, cosine 1.

    ``ball``: dense clip_id, frame, x, y; ``wrist``: clip_id, frame, x, y, speed (one row a frame); ``racket``: clip_id, frame, cx, cy."""
    w = series.window(CLIP, ["frame"])
    b = ball.withColumns({"_bx": F.lag("x", half).over(w), "_by": F.lag("y", half).over(w), "_ax": F.lead("x", half).over(w), "_ay": F.lead("y", half).over(w)})
    vb = F.sqrt((F.col("x") - F.col("_bx")) ** 2 + (F.col("y") - F.col("_by")) ** 2) / half
    va = F.sqrt((F.col("_ax") - F.col("x")) ** 2 + (F.col("_ay") - F.col("y")) ** 2) / half
    dot = (F.col("x") - F.col("_bx")) * (F.col("_ax") - F.col("x")) + (F.col("y") - F.col("_by")) * (F.col("_ay") - F.col("y"))
    b = b.withColumn("_vb", vb).withColumn("_va", va).withColumn("_cos", F.when((vb > 0) & (va > 0), dot / (vb * va * half * half)))
    rows = at.join(b.select("clip_id", "frame", "x", "y", "_vb", "_va", "_cos"), ["clip_id", "frame"], "left").join(wrist.select("clip_id", "frame", F.col("x").alias("_wx"), F.col("y").alias("_wy"), "speed"), ["clip_id", "frame"], "left")
    near = rows.select("clip_id", "frame", "x", "y").distinct().join(racket, ["clip_id", "frame"]).groupBy("clip_id", "frame").agg(F.min(F.sqrt((F.col("cx") - F.col("x")) ** 2 + (F.col("cy") - F.col("y")) ** 2)).alias("_rd"))
    rows = rows.join(near, ["clip_id", "frame"], "left")
    zero, far = F.lit(0.0), F.lit(NO_BALL)
    return rows.select(
        *at.columns,
        F.coalesce("speed", zero).alias("wrist_speed"),
        F.coalesce(F.sqrt((F.col("x") - F.col("_wx")) ** 2 + (F.col("y") - F.col("_wy")) ** 2), far).alias("ball_dist"),
        F.coalesce("_vb", zero).alias("ball_vel_before"), F.coalesce("_va", zero).alias("ball_vel_after"),
        F.coalesce(F.abs(F.col("_va") - F.col("_vb")), zero).alias("ball_vel_change"), F.coalesce("_cos", F.lit(NO_ANGLE)).alias("ball_angle_change"), F.coalesce("_rd", far).alias("racket_dist"),
    )


def detect_hits(ball: DataFrame, wrists: DataFrame, fps: float, reach: float, least_speed: float, min_gap_s: float = 0.75) -> DataFrame:
    """Hits: wrist speed peaks, HIGH with a turning point of the ball within five frames, else MEDIUM unless the ball is seen
    farther away than ``reach``; LOW for turning points no peak covers, with the nearest wrist in reach. Within the minimal gap
    the more confident stays, then the faster.

    ``ball``: clip_id, frame, x, y (present frames only); ``wrists``: clip_id, track_id, side, frame, x, y, vis."""
    keys = ["clip_id", "track_id", "side"]
    w = series.neighbour_speed(wrists, keys, ["frame"], "x", "y", "vis", 0.2, "speed")
    peaks = series.local_maxima(w.filter("speed is not null"), keys, ["frame"], "speed", PEAK_HALF, least_speed)
    peaks = fold.fold_kept(peaks.select(*keys, "frame", "speed", "x", "y"), keys, ["frame"], "frame", MERGE, lambda new, kept: new["speed"] > kept["speed"], ["frame", "speed", "x", "y"])
    turns = series.turning_points(ball, CLIP, ["frame"], "x", "y", LEAST_STEP).select("clip_id", "frame")
    marked = joins.band_semi(peaks, turns, CLIP, "frame", "frame", NEAR).select(*keys, "frame").withColumn("_high", F.lit(True))
    b = ball.select("clip_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    p = peaks.join(marked, [*keys, "frame"], "left").join(b, ["clip_id", "frame"], "left")
    dist = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    p = p.withColumn("ball_dist", dist).withColumn("confidence", F.when(F.col("_high"), "HIGH").otherwise("MEDIUM"))
    p = p.filter((F.col("confidence") == "HIGH") | F.col("ball_dist").isNull() | (F.col("ball_dist") < reach))
    lone = series.gap_groups(joins.band_anti(turns, peaks.select("clip_id", "frame"), CLIP, "frame", "frame", NEAR), CLIP, "frame", NEAR).select("clip_id", F.col("median").alias("frame"))
    near = joins.nearest(lone.join(b, ["clip_id", "frame"]), w.select("clip_id", "frame", "track_id", "side", "x", "y", "speed"), ["clip_id", "frame"], dist, ["track_id", "side", "speed"], [], "ball_dist", F.lit(reach))
    low = near.select("clip_id", "track_id", "side", "frame", F.coalesce("speed", F.lit(0.0)).alias("speed"), "ball_dist", F.lit("LOW").alias("confidence"))
    both = p.select("clip_id", "track_id", "side", "frame", "speed", "ball_dist", "confidence").unionByName(low)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    both = both.withColumn("rank", rank).withColumn("seen", F.col("ball_dist").isNotNull().cast("int"))
    better = lambda n, k: F.struct(n["rank"], n["seen"], n["speed"]) > F.struct(k["rank"], k["seen"], k["speed"])
    return fold.fold_kept(both, CLIP, ["frame", "track_id", "side"], "frame", int(min_gap_s * fps), better, ["frame", "track_id", "side", "speed", "ball_dist", "confidence", "rank", "seen"]).drop("rank", "seen")


def bounces(ball: DataFrame, half: int = 2) -> DataFrame:
    """Bounce frames of a dense ball track: smoothed, turning upward at a low point, the strongest of any within ten frames."""
    m = series.moving_average(ball, CLIP, ["frame"], "y", half, "m")
    w = series.window(CLIP, ["frame"])
    m = m.withColumn("vy", (F.lead("m").over(w) - F.lag("m").over(w)) / 2)
    found = series.bounce_candidates(m, CLIP, ["frame"], "m", "vy")
    return fold.fold_kept(found.select("clip_id", "frame", "vy_before", "x", "m"), CLIP, ["frame"], "frame", 10, lambda new, kept: new["vy_before"] > kept["vy_before"], ["frame", "vy_before", "x", "m"])


def add_bounces(hits: DataFrame, found: DataFrame, homography: list, fps: float, within: int = BOUNCE_WITHIN) -> DataFrame:
    """Adds to every hit the first bounce after it (within ``within`` frames): frame, court x and z, inside the court, delay; NULLs where none."""
    out = joins.asof_forward(hits, found.select("clip_id", "frame", F.col("x").alias("_px"), F.col("m").alias("_py")), CLIP, "frame", "frame", within, "bounce_frame", ["_px", "_py"])
    x, z = court.apply_homography(homography, F.col("_px"), F.col("_py"))
    out = out.withColumn("court_x", x).withColumn("court_z", z)
    inside = F.when(F.col("bounce_frame").isNotNull(), court.in_court(F.col("court_x"), F.col("court_z")))
    return out.withColumn("in_court", inside).withColumn("delay_ms", (F.col("bounce_frame") - F.col("frame")) / fps * 1000).drop("_px", "_py")


def nearest_chain(boxes: DataFrame, gate: float = GATE, chunk: int = 256) -> DataFrame:
    """Ball association: in each frame the box nearest to the last point, or the first box where none is within ``gate``.

    A frame with one box takes it whatever came before, so the first such frame of every ``chunk`` frames starts an island of its own.
    ``boxes``: clip_id, frame, box_idx, x, y."""
    rows = boxes.select(*CLIP, "frame", "box_idx", "x", "y").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*CLIP, "frame"))).withColumn("_chunk", F.floor(F.col("frame") / chunk))
    cuts = rows.groupBy(*CLIP, "_chunk").agg(F.min(F.when(F.col("_n") == 1, F.col("frame"))).alias("_cut"))
    before = F.last(F.when(F.col("_cut").isNotNull(), F.col("_chunk")), True).over(Window.partitionBy(*CLIP).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.withColumn("_before", F.coalesce(before, F.lit(-(1 << 40)))).select(F.col("clip_id").alias("_k_clip_id"), F.col("_chunk").alias("_k_chunk"), "_cut", "_before")
    rows = rows.join(cuts, F.col("clip_id").eqNullSafe(F.col("_k_clip_id")) & (F.col("_chunk") == F.col("_k_chunk")))
    rows = rows.withColumn("island", F.when(F.col("frame") >= F.col("_cut"), F.col("_chunk")).otherwise(F.col("_before")))
    return scan.scan(rows, [*CLIP, "island"], ["frame", "box_idx"], ["frame", "x", "y"], lambda: _Nearest(gate), "frame int, x double, y double").drop("island")


class _Nearest(scan.ByFrame):
    def __init__(self, gate: float):
        super().__init__()
        self.gate, self.point = gate, None

    def frame(self, frame, rows):
        near = min(rows, key=lambda b: math.hypot(b[0] - self.point[0], b[1] - self.point[1])) if self.point else None
        good = near is not None and math.hypot(near[0] - self.point[0], near[1] - self.point[1]) <= self.gate
        self.point = near if good else rows[0]
        yield frame, *self.point


def kalman_chain(boxes: DataFrame, gate: float = GATE, coast: int = 30, q: float = 1e-2, r: float = 5.0, chunk: int = scan.CHUNK) -> DataFrame:
    """Ball association with a constant-velocity Kalman filter; x and y are two filters with one covariance. A box beyond the
    gate is no measurement; after ``coast`` frames without one the track ends and the next box starts another.

    A pause of more than ``coast`` + 1 frames ends any track, so a clip falls into islands, each a stream with one filter as state.
    ``boxes``: clip_id, frame, box_idx, x, y with gaps allowed. Returns the filtered track, coasted frames flagged."""
    rows = scan.islands(boxes.select(*CLIP, "frame", "box_idx", "x", "y"), CLIP, "frame", "box_idx", coast + 1, "island", chunk)
    return scan.scan(rows, [*CLIP, "island"], ["frame", "box_idx"], ["frame", "x", "y", "last_island"], lambda: _Kalman(gate, coast, q, r), "frame int, x double, y double, coasted boolean").drop("island")


class _Kalman(scan.ByFrame):
    """The filter of one island; ``track``: position and speed, then variance, covariance and variance of speed."""

    def __init__(self, gate: float, coast: int, q: float, r: float):
        super().__init__()
        self.gate, self.coast, self.q, self.r = gate, coast, q, r
        self.track, self.missed, self.next, self.final = None, 0, None, True

    def predict(self) -> None:
        (x, y, vx, vy), (a, b, c) = self.track
        self.track = (x + vx, y + vy, vx, vy), (a + 2 * b + c + self.q, b + c, c + self.q)

    def miss(self, frame: int):
        self.missed += 1
        if self.missed > self.coast:
            self.track = None
        else:
            yield frame, self.track[0][0], self.track[0][1], True

    def pause(self, upto: int):
        while self.track is not None and self.next < upto:
            self.predict()
            yield from self.miss(self.next)
            self.next += 1

    def frame(self, frame, rows):
        self.final = rows[0][2]
        if self.next is not None:
            yield from self.pause(frame)
        self.next = frame + 1
        if self.track is None:
            x, y = rows[0][:2]
            self.track, self.missed = ((x, y, 0.0, 0.0), (0.0, 0.0, 0.0)), 0
            yield frame, x, y, False
            return
        self.predict()
        (x, y, vx, vy), (a, b, c) = self.track
        near = min(rows, key=lambda p: math.hypot(p[0] - x, p[1] - y))
        if math.hypot(near[0] - x, near[1] - y) > self.gate:
            yield from self.miss(frame)
            return
        k1, k2 = a / (a + self.r), b / (a + self.r)
        dx, dy = near[0] - x, near[1] - y
        self.track, self.missed = ((x + k1 * dx, y + k1 * dy, vx + k2 * dx, vy + k2 * dy), ((1 - k1) * a, (1 - k1) * b, c - k2 * b)), 0
        yield frame, self.track[0][0], self.track[0][1], False

    def last(self):
        # the clip goes on after this island: the track coasts to its end
        return () if self.final else list(self.pause(self.next + self.coast + 1))
