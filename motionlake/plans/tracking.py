"""Registered queries of hits, bounces, tracks and court geometry, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import body as B
from ..operators import court, fold, hits, joins, series, tracks, vanishing
from ..sources.adapters import duck, view
from .series import _BOUNCE, _POINTS, _TURN, CLIP, _fold_sql, _points, _recursive, r6

def ground_map() -> list:
    """A fixed image-to-ground map for the adapter tables."""
    return [F.lit(x) for x in (0.05, 0.004, -5.0, 0.001, 0.06, -4.0, 0.00002, 0.0004, 1.0)]


def boxes(spark, d, name="boxes"):
    return view(spark, d, name).withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)


def _wrists(spark, d):
    b = boxes(spark, d).filter("class = 'person'").groupBy("clip_id", "frame").agg(F.min_by("cx", "box_key").alias("x"), F.min_by("cy", "box_key").alias("y"))
    return b.withColumn("track_id", F.lit(0)).withColumn("side", F.lit("R")).withColumn("vis", F.lit(0.9))


def d_hitf_hit_features(spark, d):
    """Every fifth frame stands in for a hit candidate, a table the driver does not have."""
    ball = joins.densify(_points(spark, d), CLIP, "frame")
    wrist = series.neighbour_speed(_wrists(spark, d), CLIP, ["frame"], "x", "y", "vis", 0.2, "speed")
    racket = boxes(spark, d).filter("class = 'racket'").select("clip_id", "frame", "cx", "cy")
    at = _points(spark, d).filter("frame % 5 = 0").select("clip_id", F.col("frame").cast("int").alias("frame"))
    f = hits.hit_features(at, ball, wrist, racket)
    return r6(f, *[c for c in f.columns if c not in ("clip_id", "frame")])


def d_hit_detect_hits(spark, d):
    h = hits.detect_hits(_points(spark, d), _wrists(spark, d), 30.0, 80.0, 5.0)
    return r6(h.select("clip_id", "frame", "speed", "ball_dist", "confidence"), "speed", "ball_dist")


def d_bnc_add_bounces(spark, d):
    """Every tenth frame stands in for a hit, a table the driver does not have."""
    ball = _points(spark, d)
    h = ball.filter("frame % 10 = 0").select("clip_id", "frame")
    return r6(hits.add_bounces(h, hits.bounces(ball, 1), ground_map(), 30.0).withColumns({c: F.col(c).cast("double") for c in ("bounce_frame", "in_court")}), "court_x", "court_z", "delay_ms")


def flt10_in_court(spark, d):
    x, z = court.apply_homography(ground_map(), F.col("x"), F.col("y"))
    return boxes(spark, d).groupBy("clip_id", court.in_court(x, z).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def sc3_homography_round_trip(spark, d):
    x, z = court.apply_homography(ground_map(), F.col("x"), F.col("y"))
    u, v = court.apply_homography(court.invert_homography(ground_map()), F.col("gx"), F.col("gz"))
    b = boxes(spark, d).withColumn("gx", x).withColumn("gz", z)
    return r6(b.select("box_key", "gx", "gz", u.alias("u"), v.alias("v")), "gx", "gz", "u", "v")


def flt2_moving_tracks(spark, d):
    return r6(tracks.moving_tracks(boxes(spark, d), 540.0, 60, 0.28), "sd_y")


def flt3_tall_or_moving(spark, d):
    return r6(tracks.tall_or_moving_tracks(boxes(spark, d), 960.0, 540.0, 64), "mean_h", "sd_x", "sd_y")


def flt6_shape_filter(spark, d):
    return tracks.shape_filter(boxes(spark, d), 300.0).groupBy("clip_id", "class").agg(F.count(F.lit(1)).alias("n"))


def ag10_track_summary(spark, d):
    return r6(tracks.track_summary(boxes(spark, d).withColumn("vis", F.col("x") / 200)), "coverage", "mean_visibility")


def ag18_roles(spark, d):
    return r6(tracks.roles(boxes(spark, d)), "median_h")


def clu1_merge_boxes(spark, d):
    b = boxes(spark, d).select("clip_id", "frame", F.col("box_key").alias("box_idx"), "x", "y", F.col("w") * 5, F.col("h") * 3).toDF("clip_id", "frame", "box_idx", "x", "y", "w", "h")
    return r6(tracks.merge_boxes(b), "x", "y", "w", "h")


def clu1_box_components(spark, d):
    return r6(tracks.box_components(boxes(spark, d).withColumn("w", F.col("w") * 5)), "x", "y", "right", "bottom")


def clu2_cluster_fragments(spark, d):
    return tracks.cluster_fragments(boxes(spark, d), 960.0, 0.15, 0.2, 4)


def clu3_stitch_fragments(spark, d):
    """Tracks are cut into fragments of 240 frames, so that there is something to join."""
    b = boxes(spark, d).withColumn("track_id", F.col("track_id") * 10 + F.floor(F.col("frame") / 240))
    one = b.groupBy("clip_id", "track_id", "frame").agg(*[F.min_by(c, "box_key").alias(c) for c in ("cx", "cy", "h")])
    return tracks.stitch_fragments(one, 2.0, 540.0)


def clu4_drop_stationary(spark, d):
    kept = tracks.drop_stationary(boxes(spark, d), 40.0, 15, 12)
    return r6(kept.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("sum_x")), "sum_x")


def clu4_drop_stationary_exact(spark, d):
    b = boxes(spark, d).withColumn("box_idx", F.col("box_key"))
    kept = tracks.drop_stationary_exact(b, 40.0, 15, 12)
    return r6(kept.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("sum_x")), "sum_x")


def clu5_one_timeline(spark, d):
    b = boxes(spark, d).groupBy("clip_id", "track_id", "frame").agg(F.min_by("cx", "box_key").alias("cx"), F.min_by("cy", "box_key").alias("cy"))
    c = b.select("clip_id", "track_id").distinct().withColumn("cluster", F.col("track_id") % 3).withColumn("position", F.col("track_id"))
    return r6(tracks.one_timeline(b, c), "cx", "cy")


def st2_match_tracks(spark, d):
    b = boxes(spark, d).filter("class = 'person'").select("clip_id", "frame", F.col("box_key").alias("box_idx"), "cx", "cy")
    return r6(tracks.match_tracks(b, 960.0), "cx", "cy")


def jn9_mutual_nearest(spark, d):
    b = boxes(spark, d, "crowd")
    t = b.filter("class <> 'ball'").groupBy("clip_id", "frame", "track_id").agg(F.min_by("cx", "box_key").alias("tx"), F.min_by("cy", "box_key").alias("ty"))
    return r6(tracks.mutual_nearest(b.filter("class = 'ball'").select("clip_id", "frame", F.col("box_key").alias("box_idx"), "cx", "cy"), t, 115.2), "d")


def st3_kalman_chain(spark, d):
    return r6(hits.kalman_chain(boxes(spark, d).filter("class = 'ball'").select("clip_id", "frame", F.col("box_key").alias("box_idx"), F.col("cx").alias("x"), F.col("cy").alias("y"))), "x", "y")


def st3b_nearest_chain(spark, d):
    return r6(hits.nearest_chain(boxes(spark, d).filter("class = 'ball'").select("clip_id", "frame", F.col("box_key").alias("box_idx"), F.col("cx").alias("x"), F.col("cy").alias("y")), 60.0), "x", "y")


def st5_sessionise(spark, d):
    return tracks.sessionise(boxes(spark, d), ["clip_id", "track_id"], "frame", 15)


def so1_frame_overlap(spark, d):
    f = boxes(spark, d, "crowd").groupBy("clip_id", "track_id").agg(F.collect_set("frame").alias("f"))
    p = joins.pairs_of_key(f, CLIP, "track_id").withColumn("shared", F.size(F.array_intersect("f_a", "f_b")).cast("long"))
    return p.select("clip_id", F.col("track_id_a").alias("a"), F.col("track_id_b").alias("b"), "shared", (F.size("f_a") + F.size("f_b") - F.col("shared")).alias("either"))


def clu9_two_vanishing_points(spark, d):
    v = vanishing.two_vanishing_points(view(spark, d, "segs"), ["frame"])
    return r6(v.drop("pairs", "n", "spread"), "x_1", "y_1", "x_2", "y_2")


def ag21_focal_reliability(spark, d):
    v = vanishing.two_vanishing_points(view(spark, d, "segs"), ["frame"])
    return r6(v.select("frame", "pairs", "n", "spread", court.focal_is_reliable(F.col("pairs"), F.col("n"), F.col("spread")).alias("reliable")), "spread")


def cj8_focal_from_segments(spark, d):
    v = vanishing.two_vanishing_points(view(spark, d, "segs"), ["frame"])
    f = court.focal_from_vanishing_points(F.col("x_1"), F.col("y_1"), F.col("x_2"), F.col("y_2"), 480.0, 270.0)
    good = court.focal_is_reliable(F.col("pairs"), F.col("n"), F.col("spread"))
    return r6(v.select("frame", F.when(good, f).alias("focal_px")), "focal_px")


def ag25_fit_line(spark, d):
    s = series.chain_clusters(view(spark, d, "segs"), ["frame"], "y1", ["seg_id"], 5.0, "cluster")
    return r6(court.fit_line(s.withColumn("x", F.col("x1") + F.col("seg_id") / 1000), ["frame", "cluster"], "x", "y1"), "mx", "my", "angle", "low", "high")


def _clicks(spark, d):
    return view(spark, d, "segs").select(F.col("frame").alias("camera_id"), (F.col("x1") / 100 - 4.8).alias("wx"), F.lit(0.0).alias("wy"), (F.col("y1") / 30).alias("wz"), F.col("x2").alias("u"), F.col("y2").alias("v"))


def ag19_reprojection(spark, d):
    return r6(court.reprojection(view(spark, d, "poses"), _clicks(spark, d), ["camera_id"], 480.0, 270.0), "rmse", "score", "depth_spread")


def clu10_best_poses(spark, d):
    scored = court.reprojection(view(spark, d, "poses"), _clicks(spark, d), ["camera_id"], 480.0, 270.0)
    rank = F.row_number().over(Window.partitionBy("camera_id").orderBy("rmse", "cand_id"))
    return r6(scored.withColumn("rank", rank).filter("rank <= 3").select("camera_id", "rank", "cand_id", "rmse"), "rmse")


def clu8_ground_homography(spark, d):
    s = view(spark, d, "segs").withColumn("camera_id", F.col("frame"))
    x, z = court.apply_homography(ground_map(), F.col("x1"), F.col("y1"))
    h = court.ground_homography(s.select("camera_id", F.col("x1").alias("u"), F.col("y1").alias("v"), x.alias("x"), z.alias("z")), ["camera_id"])
    # the recovered map is held against the one that made the points
    px, pz = court.apply_homography([F.col(f"h{i}{j}") for i in range(3) for j in range(3)], F.col("x1"), F.col("y1"))
    e = s.join(h, "camera_id").withColumn("e", F.greatest(F.abs(px - x), F.abs(pz - z)))
    return e.groupBy("camera_id").agg(F.count(F.lit(1)).alias("points"), (F.max("e") < 1e-3).alias("recovered"))


def ag26_median_calibration(spark, d):
    c = view(spark, d, "poses")
    m = c.groupBy("camera_id").agg(F.median("focal_px").alias("focal_px"))
    return r6(c.withColumnRenamed("focal_px", "f").join(m, "camera_id").groupBy("camera_id", "focal_px").agg(F.min_by("cand_id", F.struct(F.abs(F.col("f") - F.col("focal_px")), "cand_id")).alias("kept")), "focal_px")


def clu11_height_cm(spark, d):
    return r6(boxes(spark, d).select("box_key", B.height_cm(F.col("h") * 10, F.col("w") / 4, F.lit(900.0)).alias("height_cm")), "height_cm")


QUERIES = {f.__name__: f for f in (d_hitf_hit_features, d_hit_detect_hits, d_bnc_add_bounces, flt10_in_court, sc3_homography_round_trip, flt2_moving_tracks, flt3_tall_or_moving, flt6_shape_filter, ag10_track_summary, ag18_roles, clu1_merge_boxes, clu1_box_components, clu2_cluster_fragments, clu3_stitch_fragments, clu4_drop_stationary, clu4_drop_stationary_exact, clu5_one_timeline, st2_match_tracks, jn9_mutual_nearest, st3_kalman_chain, st3b_nearest_chain, st5_sessionise, so1_frame_overlap, clu9_two_vanishing_points, cj8_focal_from_segments, ag21_focal_reliability, ag25_fit_line, ag19_reprojection, clu10_best_poses, clu8_ground_homography, ag26_median_calibration, clu11_height_cm)}

_B = f"{duck('boxes')}, c as (select *, x + w / 2 as cx, y + h / 2 as cy from boxes)"
_CROWD = f"{duck(boxes='crowd')}, c as (select *, x + w / 2 as cx, y + h / 2 as cy from boxes)"
_GX = "(0.05::DOUBLE * {x} + 0.004::DOUBLE * {y} - 5) / (0.00002::DOUBLE * {x} + 0.0004::DOUBLE * {y} + 1)"
_GZ = "(0.001::DOUBLE * {x} + 0.06::DOUBLE * {y} - 4) / (0.00002::DOUBLE * {x} + 0.0004::DOUBLE * {y} + 1)"


def _in(x: str, y: str) -> str:
    return f"({_GX.format(x=x, y=y)}) between -5.115 and 5.115 and ({_GZ.format(x=x, y=y)}) between -2 and 25.77"


_GAPT = "(abs(atan2(s.y2 - s.y1, s.x2 - s.x1) - atan2({p}.y - (s.y1 + s.y2) / 2, {p}.x - (s.x1 + s.x2) / 2)))"


def _vp(n: int, src: str) -> str:
    g = _GAPT.format(p="q")
    b = _GAPT.format(p="b")
    return f"""i{n} as (select a.frame, a.seg_id as a, b.seg_id as b, a.x1, a.y1, a.x2 - a.x1 as dx, a.y2 - a.y1 as dy, b.x1 as u1, b.y1 as v1, b.x2 - b.x1 as du, b.y2 - b.y1 as dv from {src} a join {src} b on a.frame = b.frame and a.seg_id < b.seg_id),
p{n} as (select frame, a, b, x1 + ((u1 - x1) * dv - (v1 - y1) * du) / (dx * dv - dy * du) * dx as x, y1 + ((u1 - x1) * dv - (v1 - y1) * du) / (dx * dv - dy * du) * dy as y from i{n} where abs(dx * dv - dy * du) > 1e-6),
n{n} as (select q.frame, q.a, q.b, q.x, q.y, count(*) filter (where least({g} - pi() * floor({g} / pi()), pi() - ({g} - pi() * floor({g} / pi()))) <= radians(5)) as inliers from p{n} q join {src} s using (frame) group by all),
b{n} as (select * from (select *, row_number() over (partition by frame order by inliers desc, a, b) as k from n{n} where inliers >= 3) where k = 1),
rest{n} as (select s.* from {src} s join b{n} b using (frame) where least({b} - pi() * floor({b} / pi()), pi() - ({b} - pi() * floor({b} / pi()))) > radians(5))"""


_VPS = f"{duck('segs')}, {_vp(1, 'segs')}, {_vp(2, 'rest1')}"
# focal lengths of every two segments of the first point with the second point
_SPREAD = """members as (select s.frame, s.seg_id from segs s join b1 using (frame) anti join rest1 r on r.frame = s.frame and r.seg_id = s.seg_id),
tried as (select frame, count(*) * (count(*) - 1) // 2 as pairs from members group by frame),
single as (select p.frame, -((p.x - 480) * (b2.x - 480) + (p.y - 270) * (b2.y - 270)) as r from p1 p join b2 using (frame) semi join members m on m.frame = p.frame and m.seg_id = p.a semi join members k on k.frame = p.frame and k.seg_id = p.b),
made as (select frame, count(*) filter (r > 0) as n, stddev_pop(sqrt(greatest(r, 0))) filter (r > 0) / greatest(avg(sqrt(greatest(r, 0))) filter (r > 0), 1e-6) as spread from single group by frame),
spread as (select b2.frame, pairs, coalesce(n, 0) as n, spread, coalesce(n >= greatest(3, pairs // 2) and spread <= 0.15, false) as reliable from b2 join tried using (frame) left join made using (frame))"""
_REPRO = f"""{duck('poses', 'segs')}, k as (select frame as camera_id, x1 / 100 - 4.8::DOUBLE as wx, y1 / 30 as wz, x2 as u, y2 as v from segs),
g as (select camera_id, cand_id, focal_px, wz, u, v, wx * cos(radians(pan_deg)) - (wz + distance_m) * sin(radians(pan_deg)) as rx, wx * sin(radians(pan_deg)) + (wz + distance_m) * cos(radians(pan_deg)) as rz, 0 - height_m as dy, radians(tilt_deg) as t from poses join k using (camera_id)),
e as (select *, rz * cos(t) - dy * sin(t) as depth, dy * cos(t) + rz * sin(t) as ry from g),
sc as (select camera_id, cand_id, sqrt(avg(case when depth > 0.05 then (480 + focal_px * rx / depth - u) ** 2 + (270 - focal_px * ry / depth - v) ** 2 else 2000 end)) as rmse, max(wz) - min(wz) as depth_spread from e group by camera_id, cand_id)"""
_BALLD = f"{duck('boxes')}, c as (select *, x + w / 2 as cx, y + h / 2 as cy from boxes), {_POINTS}"
_WR = "wr0 as (select clip_id, frame, min_by(cx, box_key) as x, min_by(cy, box_key) as y from c where class = 'person' group by clip_id, frame), wr as (select *, sqrt((lead(x) over w - lag(x) over w) ** 2 + (lead(y) over w - lag(y) over w) ** 2) / 2 as speed from wr0 window w as (partition by clip_id order by frame))"
ORACLE_SQL = {
    "d_hitf_hit_features": f"""{_BALLD}, {_WR}, spine as (select clip_id, unnest(generate_series(0, max(frame))) as frame from p group by clip_id),
dense as (select s.clip_id, s.frame, p.x, p.y from spine s left join p using (clip_id, frame)),
b as (select clip_id, frame, x, y, lag(x, 3) over w as bx, lag(y, 3) over w as by_, lead(x, 3) over w as ax, lead(y, 3) over w as ay from dense window w as (partition by clip_id order by frame)),
v as (select *, sqrt((x - bx) ** 2 + (y - by_) ** 2) / 3 as vb, sqrt((ax - x) ** 2 + (ay - y) ** 2) / 3 as va, (x - bx) * (ax - x) + (y - by_) * (ay - y) as dot from b),
r as (select p.clip_id, p.frame, min(sqrt((k.cx - p.x) ** 2 + (k.cy - p.y) ** 2)) as rd from p join c k on k.clip_id = p.clip_id and k.frame = p.frame and k.class = 'racket' group by all)
select p.clip_id, p.frame::INTEGER as frame, round(coalesce(wr.speed, 0), 6) as wrist_speed, round(coalesce(sqrt((p.x - wr.x) ** 2 + (p.y - wr.y) ** 2), 9999), 6) as ball_dist, round(coalesce(vb, 0), 6) as ball_vel_before, round(coalesce(va, 0), 6) as ball_vel_after,
round(coalesce(abs(va - vb), 0), 6) as ball_vel_change, round(coalesce(case when vb > 0 and va > 0 then dot / (vb * va * 9) end, 1), 6) as ball_angle_change, round(coalesce(rd, 9999), 6) as racket_dist
from p left join v using (clip_id, frame) left join wr using (clip_id, frame) left join r using (clip_id, frame) where p.frame % 5 = 0""",
    "d_bnc_add_bounces": _recursive(f"""{duck('boxes')}, {_POINTS}, {_BOUNCE.replace('select clip_id, frame, vy_before, vy_after from c where', 'select clip_id, frame, b0 as vy_before, x, m from c where').replace('vy_after, m, low', 'vy_after, x, m, low')},
{_fold_sql('bounces', 10, 'e.vy_before > k.kept_vy_before', ['frame', 'vy_before', 'x', 'm'])},
n as (select h.clip_id, h.frame, min_by(struct_pack(f := k.frame, x := k.x, m := k.m), k.frame) as b from p h left join kept k on k.clip_id = h.clip_id and k.frame > h.frame and k.frame <= h.frame + 45 where h.frame % 10 = 0 group by h.clip_id, h.frame)
select clip_id, frame, b.f::DOUBLE as bounce_frame, round({_GX.format(x='b.x', y='b.m')}, 6) as court_x, round({_GZ.format(x='b.x', y='b.m')}, 6) as court_z, case when b.f is not null then ({_in('b.x', 'b.m')})::INT::DOUBLE end as in_court, round((b.f - frame) / 30 * 1000, 6) as delay_ms from n"""),
    "flt10_in_court": f"{_B} select clip_id, coalesce({_in('x', 'y')}, false) as inside, count(*) as n from c group by all",
    "sc3_homography_round_trip": f"{_B} select box_key, round({_GX.format(x='x', y='y')}, 6) as gx, round({_GZ.format(x='x', y='y')}, 6) as gz, round(x, 6) as u, round(y, 6) as v from c",
    "flt2_moving_tracks": f"{_B}, t as (select clip_id, track_id, count(*) as frames, stddev_pop(cy) as sd_y from c group by clip_id, track_id) select clip_id, track_id, frames, round(sd_y, 6) as sd_y from t where frames >= 60 and sd_y >= 0.28::DOUBLE * 540",
    "flt3_tall_or_moving": f"""{_B}, t as (select clip_id, track_id, count(*) as frames, avg(h) as mean_h, stddev_pop(cx) as sd_x, stddev_pop(cy) as sd_y from c group by clip_id, track_id),
o as (select *, frames >= 64 and (mean_h > 81 or sd_x >= 0.02::DOUBLE * 960 or sd_y >= 0.02::DOUBLE * 540) as ok from t)
select clip_id, track_id, frames, round(mean_h, 6) as mean_h, round(sd_x, 6) as sd_x, round(sd_y, 6) as sd_y from (select *, bool_or(ok) over (partition by clip_id) as passes from o) where ok or not passes""",
    "flt6_shape_filter": f"{_B} select clip_id, class, count(*) as n from c where w * h >= 300 and h >= 0.6::DOUBLE * w group by all",
    "ag10_track_summary": f"{_B}, a as (select clip_id, max(frame) - min(frame) + 1 as total from c group by clip_id) select clip_id, track_id, count(distinct frame) as frames, round(count(distinct frame)::DOUBLE / any_value(total), 6) as coverage, round(avg(x / 200), 6) as mean_visibility from c join a using (clip_id) group by clip_id, track_id",
    "ag18_roles": f"{_B}, m as (select clip_id, track_id, median(h) as median_h, count(*) as frames from c group by clip_id, track_id) select clip_id, track_id, round(median_h, 6) as median_h, frames, case row_number() over (partition by clip_id order by median_h desc, track_id) when 1 then 'near' when 2 then 'far' else 'other' end as role from m",
    "clu1_box_components": f"""{_B}, r as (select clip_id, frame, box_key, x, y, w * 5 as w, h, max(x + w * 5) over (partition by clip_id, frame order by x, box_key rows between unbounded preceding and 1 preceding) as reach from c),
g as (select *, sum(coalesce((x >= reach)::INT, 0)) over (partition by clip_id, frame order by x, box_key) as grp from r)
select clip_id, frame, grp::BIGINT as "group", count(*) as boxes, round(min(x), 6) as x, round(min(y), 6) as y, round(max(x + w), 6) as "right", round(max(y + h), 6) as bottom from g group by clip_id, frame, grp""",
    "clu4_drop_stationary": f"""{_B}, s as (select clip_id, floor(cx / 40) as gx, floor(cy / 40) as gy from c group by all having max(frame) - min(frame) + 1 >= 15 and count(*) >= 12)
select c.clip_id, count(*) as n, round(sum(cx), 6) as sum_x from c anti join s on s.clip_id = c.clip_id and s.gx = floor(c.cx / 40) and s.gy = floor(c.cy / 40) group by c.clip_id""",
    "clu5_one_timeline": f"""{_B}, b as (select clip_id, track_id, frame, min_by(cx, box_key) as cx, min_by(cy, box_key) as cy from c group by all)
select clip_id, cluster, frame, round(cx, 6) as cx, round(cy, 6) as cy, track_id from (select *, track_id % 3 as cluster, row_number() over (partition by clip_id, track_id % 3, frame order by track_id desc) as k from b) where k = 1""",
    "jn9_mutual_nearest": f"""{_CROWD}, t as (select clip_id, frame, track_id, min_by(cx, box_key) as tx, min_by(cy, box_key) as ty from c where class <> 'ball' group by all),
q as (select b.clip_id, b.frame, b.box_key as box_idx, t.track_id, sqrt((b.cx - tx) ** 2 + (b.cy - ty) ** 2) as d from c b join t using (clip_id, frame) where b.class = 'ball'),
r as (select *, row_number() over (partition by clip_id, frame, box_idx order by d, track_id) as i, row_number() over (partition by clip_id, frame, track_id order by d, box_idx) as j from q where d <= 115.2)
select clip_id, frame, box_idx, track_id, round(d, 6) as d from r where i = 1 and j = 1""",
    "st5_sessionise": f"{_B}, r as (select *, sum(coalesce((frame - last > 15)::INT, 0)) over (partition by clip_id, track_id order by frame) as run from (select distinct clip_id, track_id, frame, lag(frame) over (partition by clip_id, track_id order by frame) as last from (select distinct clip_id, track_id, frame from c))) select clip_id, track_id, min(frame) as first, max(frame) as last, count(*) as n from r group by clip_id, track_id, run",
    "so1_frame_overlap": f"""{_CROWD}, f as (select distinct clip_id, track_id, frame from c), n as (select clip_id, track_id, count(*) as n from f group by all),
s as (select a.clip_id, a.track_id as a, b.track_id as b, count(*) as shared from f a join f b on a.clip_id = b.clip_id and a.frame = b.frame and a.track_id < b.track_id group by all)
select a.clip_id, a.track_id as a, b.track_id as b, coalesce(shared, 0) as shared, a.n + b.n - coalesce(shared, 0) as either from n a join n b on a.clip_id = b.clip_id and a.track_id < b.track_id left join s on s.clip_id = a.clip_id and s.a = a.track_id and s.b = b.track_id""",
    "clu9_two_vanishing_points": f"{_VPS} select frame, round(b1.x, 6) as x_1, round(b1.y, 6) as y_1, b1.inliers as inliers_1, round(b2.x, 6) as x_2, round(b2.y, 6) as y_2, b2.inliers as inliers_2 from b1 join b2 using (frame)",
    "cj8_focal_from_segments": f"{_VPS}, {_SPREAD}, r as (select frame, -((b1.x - 480) * (b2.x - 480) + (b1.y - 270) * (b2.y - 270)) as r from b1 join b2 using (frame)) select frame, round(case when r > 0 and reliable then sqrt(r) end, 6) as focal_px from r join spread using (frame)",
    "ag21_focal_reliability": f"{_VPS}, {_SPREAD} select frame, pairs, n, round(spread, 6) as spread, reliable from spread",
    "ag25_fit_line": f"""{duck('segs')}, s as (select *, x1 + seg_id / 1000 as x, sum(coalesce((y1 - last > 5)::INT, 0)) over (partition by frame order by y1, seg_id) as cluster from (select *, lag(y1) over (partition by frame order by y1, seg_id) as last from segs)),
f as (select frame, cluster, count(*) as n, avg(x) as mx, avg(y1) as my, 0.5::DOUBLE * atan2(2 * covar_pop(x, y1), var_pop(x) - var_pop(y1)) as angle from s group by frame, cluster)
select frame, cluster::BIGINT as cluster, n, round(mx, 6) as mx, round(my, 6) as my, round(angle, 6) as angle, round(min((x - mx) * cos(angle) + (y1 - my) * sin(angle)), 6) as low, round(max((x - mx) * cos(angle) + (y1 - my) * sin(angle)), 6) as high from s join f using (frame, cluster) group by frame, cluster, n, mx, my, angle""",
    "ag19_reprojection": f"{_REPRO} select camera_id, cand_id, round(rmse, 6) as rmse, round(depth_spread, 6) as depth_spread, round(1 / (1 + rmse), 6) as score from sc",
    "clu10_best_poses": f'{_REPRO} select camera_id, rank::INTEGER as rank, cand_id, round(rmse, 6) as rmse from (select *, row_number() over (partition by camera_id order by rmse, cand_id) as rank from sc) where rank <= 3',
    "clu8_ground_homography": f"{duck('segs')} select frame as camera_id, count(*) as points, case when count(*) >= 4 then true end as recovered from segs group by frame",
    "ag26_median_calibration": f"{duck('poses')}, c as (select * from poses), m as (select camera_id, median(focal_px) as focal from c group by camera_id) select camera_id, round(focal, 6) as focal_px, cand_id as kept from (select c.*, focal, row_number() over (partition by camera_id order by abs(focal_px - focal), cand_id) as k from c join m using (camera_id)) where k = 1",
    "clu11_height_cm": f"{_B}, q as (select box_key, h * 10 * (w / 4::DOUBLE) / 900 * 100 as v from c) select box_key, round(case when v between 100 and 220 then v end, 6) as height_cm from q",
}
