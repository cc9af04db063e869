"""Plane geometry on tables: line segments, vanishing points, homographies and camera poses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]
# Court geometry in metres and the camera pose bounds of the search.
COURT_WIDTH, COURT_LENGTH, NET_Z = 8.23, 23.77, 11.885
IN_COURT = (-5.115, 5.115, -2.0, 25.77)
POSE_BOUNDS = {"height_m": (0.8, 2.2), "distance_m": (1.0, 14.0), "tilt_deg": (-15.0, 25.0), "pan_deg": (-20.0, 20.0), "focal_px": (400.0, 2200.0)}
LEAST_DEPTH = 0.05
BEHIND_COST = 2000.0


def intersections(segs: DataFrame, keys: Names, parallel: float = 1e-6) -> DataFrame:
    """Where the lines through every two segments of a key meet: ``a, b, x, y``; near-parallel pairs are left out."""
    side = lambda s: segs.select(*keys, F.col("seg_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")])
    p = side("a").join(side("b"), keys).filter("a < b")
    dx, dy, du, dv = F.col("x2_a") - F.col("x1_a"), F.col("y2_a") - F.col("y1_a"), F.col("x2_b") - F.col("x1_b"), F.col("y2_b") - F.col("y1_b")
    p = p.withColumn("_det", dx * dv - dy * du).filter(F.abs("_det") > parallel)
    t = ((F.col("x1_b") - F.col("x1_a")) * dv - (F.col("y1_b") - F.col("y1_a")) * du) / F.col("_det")
    return p.select(*keys, "a", "b", (F.col("x1_a") + t * dx).alias("x"), (F.col("y1_a") + t * dy).alias("y"))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two line directions in radians, modulo pi, at most pi / 2."""
    t = F.abs(a - b)
    t = t - F.floor(t / math.pi) * math.pi
    return F.least(t, F.lit(math.pi) - t)


def consensus(points: DataFrame, segs: DataFrame, keys: Names, degrees: float) -> DataFrame:
    """For each candidate point the number of segments that point at it within ``degrees``."""
    rows = points.join(segs, keys)
    own = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    to = F.atan2(F.col("y") - (F.col("y1") + F.col("y2")) / 2, F.col("x") - (F.col("x1") + F.col("x2")) / 2)
    return rows.groupBy(*keys, "a", "b").agg(F.count_if(angle_gap(own, to) <= math.radians(degrees)).alias("inliers"))


def focal_from_vanishing_points(x1: Column, y1: Column, x2: Column, y2: Column, cx: float, cy: float) -> Column:
    """Focal length from two vanishing points of perpendicular directions; NULL where the radicand is not positive."""
    r = -((x1 - cx) * (x2 - cx) + (y1 - cy) * (y2 - cy))
    return F.when(r > 0, F.sqrt(r))


#: Spread of the focal lengths of single pairs up to which they are trusted.
MOST_SPREAD = 0.15


def focal_is_reliable(pairs: Column, n: Column, spread: Column) -> Column:
    """Whether pairs of one vanishing point's segments agree on the focal length: at least three, and half of the pairs, give one."""
    return F.coalesce((n >= F.greatest(F.lit(3), F.floor(pairs / 2))) & (spread <= MOST_SPREAD), F.lit(False))


def fit_line(df: DataFrame, keys: Names, x: str, y: str) -> DataFrame:
    """Total least squares per key: ``mx, my`` (mean), ``angle``, ``low, high`` (extent along the line), ``n``."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cov"))
    sums = sums.withColumn("angle", 0.5 * F.atan2(2 * F.col("_cov"), F.col("_vx") - F.col("_vy"))).drop("_vx", "_vy", "_cov")
    along = (F.col(x) - F.col("mx")) * F.cos("angle") + (F.col(y) - F.col("my")) * F.sin("angle")
    return df.join(sums, keys).groupBy(*keys, "n", "mx", "my", "angle").agg(F.min(along).alias("low"), F.max(along).alias("high"))


def apply_homography(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Image point to ground point by nine matrix columns; NULL where the scale vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) >= 1e-8
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def invert_homography(h: list[Column]) -> list[Column]:
    """The inverse map, up to scale (adjugate)."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def in_court(x: Column, z: Column) -> Column:
    """Inside the court with its margin; unknown is outside."""
    return F.coalesce(x.between(IN_COURT[0], IN_COURT[1]) & z.between(IN_COURT[2], IN_COURT[3]), F.lit(False))


def project(x: Column, y: Column, z: Column, height: Column, distance: Column, tilt_deg: Column, pan_deg: Column, focal: Column, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a world point (x right, y up, z away from the near baseline) for a camera behind the baseline; NULL behind it."""
    t, p = F.radians(tilt_deg), F.radians(pan_deg)
    dx, dy, dz = x, y - height, z + distance
    rx, rz = dx * F.cos(p) - dz * F.sin(p), dx * F.sin(p) + dz * F.cos(p)
    ry, depth = dy * F.cos(t) + rz * F.sin(t), rz * F.cos(t) - dy * F.sin(t)
    ok = depth > LEAST_DEPTH
    return F.when(ok, cx + focal * rx / depth), F.when(ok, cy - focal * ry / depth), depth


def reprojection(poses: DataFrame, clicks: DataFrame, keys: Names, cx: float, cy: float) -> DataFrame:
    """Root mean square pixel error of every pose against every click of its key (a camera), ``rmse`` and ``score``; a click behind the
    camera costs a constant. A camera has a few dozen clicks, so the join is no larger than poses times that."""
    rows = poses.join(clicks, keys)
    u, v, _ = project(F.col("wx"), F.col("wy"), F.col("wz"), F.col("height_m"), F.col("distance_m"), F.col("tilt_deg"), F.col("pan_deg"), F.col("focal_px"), cx, cy)
    cost = F.when(u.isNull(), F.lit(BEHIND_COST)).otherwise((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2)
    out = rows.groupBy(*keys, "cand_id").agg(F.sqrt(F.avg(cost)).alias("rmse"), (F.max("wz") - F.min("wz")).alias("depth_spread"))
    return out.withColumn("score", 1 / (1 + F.col("rmse")))


def ground_homography(points: DataFrame, keys: Names) -> DataFrame:
    """Least-squares homography per key from ``u, v, x, z`` rows, exact for four points: ``h00`` to ``h22``, NULL for fewer than four.

    The normal equations are moment sums, one aggregate over any number of points; only the 8 by 8 solve is Python, a row per key."""
    u, v, x, z, one, zero = F.col("u"), F.col("v"), F.col("x"), F.col("z"), F.lit(1.0), F.lit(0.0)
    rows = [([u, v, one, zero, zero, zero, -x * u, -x * v], x), ([zero, zero, zero, u, v, one, -z * u, -z * v], z)]
    ata = [F.sum(sum((r[i] * r[j] for r, _ in rows[1:]), rows[0][0][i] * rows[0][0][j])).alias(f"a{i}{j}") for i in range(8) for j in range(i, 8)]
    atb = [F.sum(rows[0][0][i] * rows[0][1] + rows[1][0][i] * rows[1][1]).alias(f"b{i}") for i in range(8)]
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ata, *atb)
    names = [f"h{i}{j}" for i in range(3) for j in range(3)]

    def solve(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            grid = np.full((len(pdf), 9), np.nan)
            for r, row in enumerate(pdf.to_dict("records")):
                if row["n"] >= 4:
                    a = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(8)] for i in range(8)])
                    if np.linalg.matrix_rank(a) == 8:
                        grid[r] = [*np.linalg.solve(a, np.array([row[f"b{i}"] for i in range(8)])), 1.0]
            for c, n in enumerate(names):
                out[n] = pd.Series(grid[:, c], index=out.index)
            yield out

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name in keys), *(f"{n} double" for n in names)])
    solved = sums.mapInPandas(solve, schema)
    return solved.select(*keys, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def corners(segs: DataFrame, keys: Names, width: float, height: float, flat_deg: float = 12.0, gap: float = 20.0) -> DataFrame:
    """The four court corners per key (``corner, x, y``), only where all four are found inside the picture with a 30 % margin."""
    return corner_candidates(segs, keys, width, height, flat_deg, gap).filter("_ok and _n = 4").drop("_ok", "_n")


def corner_candidates(segs: DataFrame, keys: Names, width: float, height: float, flat_deg: float = 12.0, gap: float = 20.0) -> DataFrame:
    """Court corners per key from line segments: near-horizontal ones chained by height give base and service line, the others
    chained by position the left and right side line, and their crossings the corners; ``_ok``: all of the key's are inside the
    picture with a 30 % margin, ``_n``: how many there are. ``segs``: keys, seg_id, x1, y1, x2, y2."""
    from . import series

    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    lean = F.least(F.abs(angle - 180 * F.round(angle / 180)), F.lit(90.0))
    s = segs.withColumn("_flat", lean < flat_deg).withColumn("_my", (F.col("y1") + F.col("y2")) / 2).withColumn("_mx", (F.col("x1") + F.col("x2")) / 2)
    s = s.withColumn("_pos", F.when(F.col("_flat"), F.col("_my")).otherwise(F.col("_mx")))
    c = series.chain_clusters(s, [*keys, "_flat"], "_pos", ["seg_id"], gap, "_c")
    pts = c.select(*keys, "_flat", "_c", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*keys, "_flat", "_c", "p.*")
    lines = fit_line(pts, [*keys, "_flat", "_c"], "x", "y")
    rank = lambda o: F.row_number().over(Window.partitionBy(*keys, "_flat").orderBy(*o))
    lines = lines.withColumn("_low", rank([F.desc("my"), "_c"])).withColumn("_left", rank(["mx", "_c"])).withColumn("_right", rank([F.desc("mx"), "_c"]))
    name = F.when(F.col("_flat") & (F.col("_low") == 1), "base").when(F.col("_flat") & (F.col("_low") == 2), "service").when(~F.col("_flat") & (F.col("_left") == 1), "left").when(~F.col("_flat") & (F.col("_right") == 1), "right")
    lines = lines.withColumn("name", name).filter("name is not null").select(*keys, "name", "mx", "my", F.cos("angle").alias("dx"), F.sin("angle").alias("dy"))
    across = lines.filter("name in ('base', 'service')").withColumnsRenamed({n: f"{n}_h" for n in ("name", "mx", "my", "dx", "dy")})
    j = lines.filter("name in ('left', 'right')").join(across, keys)
    det = F.col("dx") * F.col("dy_h") - F.col("dy") * F.col("dx_h")
    j = j.withColumn("_det", det).filter(F.abs("_det") > 1e-9)
    t = ((F.col("mx_h") - F.col("mx")) * F.col("dy_h") - (F.col("my_h") - F.col("my")) * F.col("dx_h")) / F.col("_det")
    j = j.select(*keys, F.concat_ws("_", "name_h", "name").alias("corner"), (F.col("mx") + t * F.col("dx")).alias("x"), (F.col("my") + t * F.col("dy")).alias("y"))
    inside = F.col("x").between(-0.3 * width, 1.3 * width) & F.col("y").between(-0.3 * height, 1.3 * height)
    whole = Window.partitionBy(*keys)
    return j.withColumn("_ok", F.min(inside).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))


def project_lines(poses: DataFrame, lines: DataFrame, cx: float, cy: float) -> DataFrame:
    """Both ends of every court line in the picture of every pose; NULLs where an end is behind the camera.
    ``lines``: line, x1, y1, z1, x2, y2, z2 (a fixed handful, broadcast)."""
    j = poses.crossJoin(F.broadcast(lines))
    cam = [F.col(c) for c in ("height_m", "distance_m", "tilt_deg", "pan_deg", "focal_px")]
    ends = [project(F.col(f"x{i}"), F.col(f"y{i}"), F.col(f"z{i}"), *cam, cx, cy) for i in (1, 2)]
    seen = ends[0][0].isNotNull() & ends[1][0].isNotNull()
    return j.select("cand_id", "line", *[F.when(seen, e[k]).alias(f"{n}{i}") for i, e in enumerate(ends, 1) for k, n in ((0, "u"), (1, "v"))])
