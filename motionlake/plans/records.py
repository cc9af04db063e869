"""Registered queries of the small relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import tracks
from ..sources.adapters import duck, view
from . import poses as P
from .series import r6
from .tracking import boxes


def tk2_role_order(spark, d):
    return R.in_role_order(tracks.roles(boxes(spark, d)), ["clip_id"]).select("clip_id", "place", "role", "track_id")


def tk9_longest_track(spark, d):
    return R.longest_track(view(spark, d, "boxes"), ["clip_id"])


def tk8_first_valid_calibration(spark, d):
    c = view(spark, d, "poses").select("camera_id", F.col("cand_id").alias("attempt"), "focal_px", "height_m")
    return r6(R.first_valid(c, ["camera_id"], "attempt", F.col("focal_px").between(800.0, 1000.0)), "focal_px", "height_m")


def sc9_sample_frames(spark, d):
    clips = view(spark, d, "sig").groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    return R.sample_frames(clips, 5)


def clu13_rejects(spark, d):
    clips = view(spark, d, "sig").groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("x").isNull().cast("double")).alias("lost"), F.max("x").alias("peak"))
    return R.rejects(clips, {"too_short": F.col("frames") >= 8, "tracking_lost": F.col("lost") <= 0.3, "no_peak": F.col("peak") > 60})[1]


def snk9_diagnostics(spark, d):
    return r6(R.diagnostics(P.frames(spark, d)), "core_vis", "wrist_vis", "height_frac", "hip_speed")


def prj4_aspect(spark, d):
    p = view(spark, d, "pose").filter("lm_id in (11, 12)")
    return r6(p.select("clip_id", "frame", "lm_id", R.aspect_corrected(F.col("x"), F.lit(960.0), F.lit(540.0)).alias("px")), "px")


def prj7_round2(spark, d):
    odd = F.when(F.col("x") > 90, F.lit(float("nan"))).otherwise(F.col("x") / 7)
    return view(spark, d, "sig").select("clip_id", "frame", R.round2(odd).alias("x2"))


def sc8_times(spark, d):
    lab = view(spark, d, "lab")
    ms = R.frame_ms(F.col("impact_frame"), F.col("fps"))
    return r6(lab.select("clip_id", ms.alias("impact_ms"), R.ms_frame(ms, F.col("fps")).alias("frame"), F.round(F.col("impact_frame") / F.col("fps"), 2).alias("seconds")), "impact_ms")


def src7_labelled_candidates(spark, d):
    s = view(spark, d, "sig").select("clip_id", "frame", F.when(F.col("frame") % 3 != 0, (F.col("x") > 50).cast("int")).alias("is_hit"), F.col("x").alias("wrist_speed"))
    return R.labelled_candidates(s, ["wrist_speed"])


def ux3_sql_functions(spark, d):
    """The same measures as ``sc1``, called from SQL text."""
    R.register_sql(spark)
    P.frames(spark, d).createOrReplaceTempView("ux3_frames")
    return r6(spark.sql("select clip_id, frame, line_angle_deg(p12.x - p11.x, p12.y - p11.y) as line, rotation_deg(p12.x - p11.x, p12.z - p11.z) as turn, visibility_flag(p16.vis) as wrist from ux3_frames"), "line", "turn")


QUERIES = {f.__name__: f for f in (tk2_role_order, tk9_longest_track, tk8_first_valid_calibration, sc9_sample_frames, clu13_rejects, snk9_diagnostics, prj4_aspect, prj7_round2, sc8_times, src7_labelled_candidates, ux3_sql_functions)}

_CORE = P._CORE
ORACLE_SQL = {
    "tk2_role_order": f"""{duck('boxes')}, m as (select clip_id, track_id, row_number() over (partition by clip_id order by median(h) desc, track_id) as r from boxes group by clip_id, track_id), q as (select clip_id, track_id, case r when 1 then 'near' when 2 then 'far' else 'other' end as role from m)
select clip_id, row_number() over (partition by clip_id order by case role when 'near' then 1 when 'far' then 2 else 3 end, track_id)::INTEGER as place, role, track_id from q""",
    "tk9_longest_track": f"{duck('boxes')}, n as (select clip_id, track_id, count(*) as frames from boxes group by clip_id, track_id) select clip_id, track_id, frames from (select *, row_number() over (partition by clip_id order by frames desc, track_id) as k from n) where k = 1",
    "tk8_first_valid_calibration": f"""{duck('poses')}, q as (select camera_id, cand_id as attempt, focal_px, height_m, focal_px between 800 and 1000 as valid from poses)
select camera_id, attempt, round(focal_px, 6) as focal_px, round(height_m, 6) as height_m, valid from (select *, row_number() over (partition by camera_id order by valid desc, attempt) as k from q) where k = 1""",
    "sc9_sample_frames": f"""{duck('sig')}, c as (select clip_id, count(*) as frames from sig group by clip_id), s as (select distinct clip_id, floor(i * (frames - 1) / 4)::INTEGER as frame from c, (select unnest(generate_series(0, 4)) as i))
select clip_id, (row_number() over (partition by clip_id order by frame) - 1)::INTEGER as nth, frame from s""",
    "clu13_rejects": f"""{duck('sig')}, c as (select clip_id, count(*) as frames, avg((x is null)::INT::DOUBLE) as lost, max(x) as peak from sig group by clip_id)
select * from (select clip_id, case when frames < 8 then 'too_short' when lost > 0.3 then 'tracking_lost' when not coalesce(peak > 60, false) then 'no_peak' end as reason from c) where reason is not null""",
    "snk9_diagnostics": f"""{P._BASE}, h as (select *, (x23 + x24) / 2 as hx, (y23 + y24) / 2 as hy from wide)
select clip_id, frame, round({_CORE}, 6) as core_vis, round((v15 + v16) / 2, 6) as wrist_vis, round(abs((y27 + y28) / 2 - y0), 6) as height_frac,
round(case when t_ms - lag(t_ms) over w > 0 then sqrt((hx - lag(hx) over w) ** 2 + (hy - lag(hy) over w) ** 2) / ((t_ms - lag(t_ms) over w) / 1000) end, 6) as hip_speed from h window w as (partition by clip_id order by frame)""",
    "prj4_aspect": f"{duck('pose')} select clip_id, frame, lm_id, round(x * 960 / 540, 6) as px from pose where lm_id in (11, 12)",
    "prj7_round2": f"{duck('sig')} select clip_id, frame, case when x > 90 then null else round(x / 7, 2) end as x2 from sig",
    "sc8_times": f"{duck('lab')} select clip_id, round(impact_frame * 1000 / fps, 6) as impact_ms, impact_frame::INTEGER as frame, round(impact_frame / fps, 2) as seconds from lab",
    "src7_labelled_candidates": f"{duck('sig')} select clip_id, frame, (x > 50)::INTEGER as is_hit, coalesce(x, 0) as wrist_speed from sig where frame % 3 <> 0 and x is not null",
    "ux3_sql_functions": f"""{P._BASE} select clip_id, frame, round(degrees(atan2(y12 - y11, x12 - x11)) - floor(degrees(atan2(y12 - y11, x12 - x11)) / 180) * 180, 6) as line, round({P._SH}, 6) as turn,
case when v16 >= 0.8 then 'visible' when v16 >= 0.5 then 'low_confidence' else 'not_detectable' end as wrist from wide""",
}
