"""Court jobs: calibration of many frames with a reason for each that fails, and camera poses ranked over clicks.

Candidates of the pose search are made where they are scored, by a low-discrepancy rule over the bounds, so the same
numbers come out on any cluster; a camera's clicks, a few dozen, travel with it as an array. The score is a caller's expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import court

Names = list[str]
# Where the four corners lie on the ground (across, away from the near baseline), and the net, in metres.
GROUND = {"base_left": (-4.115, 0.0), "base_right": (4.115, 0.0), "service_left": (-4.115, 5.485), "service_right": (4.115, 5.485)}
NET_DEPTH, NET_HEIGHT = 11.885, 0.914
LEAST_CLICKS, LEAST_SPREAD = 4, 3.0
MATRIX = [f"h{i}{j}" for i in range(3) for j in range(3)]
POSE = tuple(court.POSE_BOUNDS)


def calibrate_frames(segs: DataFrame, keys: Names, net: DataFrame, width: float, height: float) -> DataFrame:
    """A row for every key (camera and frame) of ``segs``: the map from picture to ground (``h00`` to ``h22``), ``focal_px``, ``valid`` and the ``reason``
    where not: fewer than four corners, points that give no map, or no net. ``net``: keys, net_px (its height in the picture).

    Points are scaled to the picture before their moments are summed, and the map is scaled back."""
    found = court.corner_candidates(segs, keys, width, height)
    world = F.create_map(*[x for name, (gx, gz) in GROUND.items() for x in (F.lit(name), F.struct(F.lit(gx).alias("x"), F.lit(gz).alias("z")))])
    good = found.filter("_ok and _n = 4").withColumn("_g", world[F.col("corner")])
    half = (width / 2, height / 2)
    unit = good.select(*keys, ((F.col("x") - half[0]) / half[0]).alias("u"), ((F.col("y") - half[1]) / half[1]).alias("v"), F.col("_g.x").alias("x"), F.col("_g.z").alias("z"))
    h = court.ground_homography(unit, keys)
    back = {}
    for i in range(3):
        a, b, c = (F.col(f"h{i}{j}") for j in range(3))
        back |= {f"h{i}0": a / half[0], f"h{i}1": b / half[1], f"h{i}2": c - a - b}
    h = h.select(*keys, *[v.alias(k) for k, v in back.items()])
    corners = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_corners"), F.bool_and("_ok").alias("_all"))
    j = segs.select(*keys).distinct().join(corners, keys, "left").join(h, keys, "left").join(net.select(*keys, "net_px"), keys, "left")
    n = F.coalesce("_corners", F.lit(0))
    reason = F.when(n < 4, F.format_string("%d of 4 corners", n)).when(~F.col("_all"), "corners outside the picture").when(F.col("h00").isNull(), "no map").when(F.col("net_px").isNull() | (F.col("net_px") <= 0), "no net")
    focal = F.when(reason.isNull(), F.col("net_px") * NET_DEPTH / NET_HEIGHT)
    return j.select(*keys, *MATRIX, focal.alias("focal_px"), reason.isNull().alias("valid"), reason.alias("reason"))


def calibrate(frames: DataFrame, keys: Names, frame: str) -> DataFrame:
    """One row a key over the frames of ``calibrate_frames``: the median focal length of the valid ones, the map of the frame nearest to it
    (ties to the earlier), how many there were, and the reasons of the others in order."""
    by = Window.partitionBy(*keys)
    rows = frames.withColumn("_median", F.median(F.when(F.col("valid"), F.col("focal_px"))).over(by))
    near = F.min(F.when(F.col("valid"), F.struct(F.abs(F.col("focal_px") - F.col("_median")).alias("d"), F.col(frame).alias("frame"), *MATRIX)))
    a = rows.groupBy(*keys).agg(F.first("_median").alias("focal_px"), near.alias("_b"), F.count_if("valid").alias("valid_frames"), F.count(F.lit(1)).alias("frames"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return a.select(*keys, "focal_px", F.col("_b.frame").alias("kept_frame"), *[F.col(f"_b.{m}").alias(m) for m in MATRIX], "valid_frames", "frames", (F.col("valid_frames") > 0).alias("valid"), "reasons")


def _ratios(n: int) -> list[float]:
    """Steps of the additive sequence that fills n dimensions evenly: powers of the root of x^(n + 1) = x + 1."""
    x = 2.0
    for _ in range(60):
        x = (1 + x) ** (1 / (n + 1))
    return [math.fmod(x ** -(k + 1), 1) for k in range(n)]


def candidates(number: Column, bounds: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Values of the ``number``-th candidate inside bounds, field by field."""
    out = {}
    for (name, (lo, hi)), step in zip(bounds.items(), _ratios(len(bounds))):
        at = number.cast("double") * F.lit(step) + 0.5
        out[name] = lo + (hi - lo) * (at - F.floor(at))
    return out


def mean_square_error(pose: Column, clicks: Column, cx: float, cy: float) -> Column:
    """Mean squared distance of the clicks (``wx, wy, wz, u, v``) from where a pose puts them; one behind the camera costs a constant."""
    cam = [pose[c] for c in POSE]

    def add(total, c):
        u, v, _ = court.project(c["wx"], c["wy"], c["wz"], *cam, cx, cy)
        return total + F.coalesce((u - c["u"]) ** 2 + (v - c["v"]) ** 2, F.lit(court.BEHIND_COST))

    return F.aggregate(clicks, F.lit(0.0), add) / F.size(clicks)


def search_poses(clicks: DataFrame, keys: Names, cx: float, cy: float, cost: Callable[[Column, Column], Column] | None = None, n: int = 2048, seeds: int = 4, rounds: int = 1, zoom: float = 0.25, bounds: dict | None = None) -> DataFrame:
    """The best camera pose of every key over its clicks (keys, wx, wy, wz, u, v), with ``rmse``, ``score`` 1 / (1 + rmse), ``clicks``, ``depth_spread`` and ``warnings``.

    ``n`` candidates fill the bounds; each further round puts ``n / seeds`` into a share ``zoom`` of them around each of the ``seeds`` best.
    Fewer than four clicks give no pose and score 0; a depth spread under 3 m, and no click above the ground, are warned of.
    ``cost(pose, clicks)``: a Column to be smallest, by default the mean squared error."""
    cost = cost or (lambda p, c: mean_square_error(p, c, cx, cy))
    box = bounds or court.POSE_BOUNDS
    own = clicks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("wx", "wy", "wz", "u", "v"))).alias("c"), (F.max("wz") - F.min("wz")).alias("depth_spread"), F.max("wy").alias("_top"))
    pose = lambda values: F.struct(*[values[c].alias(c) for c in POSE])
    limits = {c: (F.lit(float(lo)), F.lit(float(hi))) for c, (lo, hi) in box.items()}
    enough = own.filter(F.size("c") >= LEAST_CLICKS)

    def best(rows: DataFrame, k: int) -> DataFrame:
        """The k cheapest candidates of a key as an array; a key's candidates are counted, not gathered."""
        scored = rows.withColumn("cost", cost(F.col("pose"), F.col("c")))
        w = Window.partitionBy(*keys).orderBy("cost", "number")
        few = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return few.groupBy(*keys).agg(F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("cost", "number", "pose"))).alias("best"))

    rows = enough.select(*keys, "c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("number"))
    top = best(rows.withColumn("pose", pose(candidates(F.col("number"), limits))), seeds if rounds > 1 else 1)
    for r in range(1, rounds):
        share = zoom**r / 2
        seed = top.select(*keys, "c", F.posexplode("best").alias("s", "b"))
        around = {c: (F.greatest(lo, F.col("b")["pose"][c] - (hi - lo) * share), F.least(hi, F.col("b")["pose"][c] + (hi - lo) * share)) for c, (lo, hi) in limits.items()}
        seed = seed.select(*keys, "c", "s", "b", F.explode(F.sequence(F.lit(0), F.lit(max(1, n // seeds) - 1))).alias("k"))
        fresh = seed.select(*keys, "c", ((F.lit(r * seeds) + F.col("s")) * n + F.col("k")).alias("number"), pose(candidates(F.col("k"), around)).alias("pose"))
        kept = top.select(*keys, "c", F.explode("best").alias("b")).select(*keys, "c", F.col("b.number").alias("number"), F.col("b.pose").alias("pose"))
        top = best(fresh.unionByName(kept), seeds if r < rounds - 1 else 1)
    found = top.select(*keys, F.element_at("best", 1).alias("_b"))
    out = own.join(found, keys, "left")
    few, flat, ground = F.size("c") < LEAST_CLICKS, F.col("depth_spread") < LEAST_SPREAD, F.col("_top") <= 0
    warnings = F.array_join(F.array_compact(F.array(F.when(few, "fewer than 4 clicks"), F.when(flat, "depth spread under 3 m"), F.when(ground, "no click above the ground"))), "; ")
    rmse = F.sqrt(F.col("_b.cost"))
    return out.select(*keys, *[F.col(f"_b.pose.{c}").alias(c) for c in POSE], rmse.alias("rmse"), F.coalesce(1 / (1 + rmse), F.lit(0.0)).alias("score"), F.size("c").cast("long").alias("clicks"), "depth_spread", warnings.alias("warnings"))
