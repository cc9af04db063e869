"""Registered queries of the pose operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import body as B
from ..operators import poses
from ..operators.poses import at, mid
from ..sources.adapters import duck, view
from .series import r6


def frames(spark, d):
    return poses.wide(view(spark, d, "pose"))


def prj2_landmark_pick(spark, d):
    return r6(frames(spark, d).select("clip_id", "frame", at(16, "x").alias("wrist_x"), mid(23, 24, "y").alias("hip_y")), "wrist_x", "hip_y")


def prj3_uncrop(spark, d):
    x, y = B.uncrop(F.col("x"), F.col("y"), F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(300.0), F.lit(960.0), F.lit(540.0))
    return r6(view(spark, d, "pose").filter("lm_id < 4").select("clip_id", "lm_id", "frame", x.alias("fx"), y.alias("fy")), "fx", "fy")


def prj6_visibility_flag(spark, d):
    f = frames(spark, d)
    return f.groupBy("clip_id", B.visibility_flag(poses.core_visibility()).alias("flag"), B.visibility_flag(poses.core_visibility(), True).alias("capped")).agg(F.count(F.lit(1)).alias("n"))


def sc1_geometry(spark, d):
    a = B.joint_angle(at(12, "x"), at(12, "y"), at(14, "x"), at(14, "y"), at(16, "x"), at(16, "y"))
    rx, ry = B.rotate(at(16, "x"), at(16, "y"), mid(23, 24, "x"), mid(23, 24, "y"), F.lit(6.0))
    f = frames(spark, d).select("clip_id", "frame", a.alias("elbow"), B.rotation_deg(at(12, "x") - at(11, "x"), at(12, "z") - at(11, "z")).alias("turn"), B.line_angle_deg(at(12, "x") - at(11, "x"), at(12, "y") - at(11, "y")).alias("line"), rx.alias("rx"), ry.alias("ry"))
    return r6(f, "elbow", "turn", "line", "rx", "ry")


def sc2_centre_of_mass(spark, d):
    return r6(frames(spark, d).select("clip_id", "frame", poses.centre_of_mass("x").alias("x"), poses.centre_of_mass("y").alias("y")), "x", "y")


def ag11_motion_energy(spark, d):
    return r6(poses.motion_energy(frames(spark, d)).select("clip_id", "frame", "energy"), "energy")


def wn30_rotation_proxy(spark, d):
    return r6(poses.rotation_proxy(frames(spark, d)).select("clip_id", "frame", "rot"), "rot")


def wn31_ready_frames(spark, d):
    return poses.ready_frames(frames(spark, d)).select("clip_id", "frame")


def d_cal_calibration(spark, d):
    return r6(poses.calibration(frames(spark, d)), "shoulder_zero", "hip_zero", "trunk", "height", "roll_deg", "deviation_deg")


def wn32_scale_series(spark, d):
    f = frames(spark, d)
    return r6(poses.scale_series(f, poses.calibration(f), 180.0), "cm")


def d_vq_quality(spark, d):
    return r6(poses.quality(frames(spark, d)), "visibility", "near_edge")


def d_kf_keyframes(spark, d):
    return r6(poses.keyframes(poses.tracked(frames(spark, d))).withColumns({k: F.col(k).cast("double") for k in poses.KEYFRAMES}), "impact_ms")


def d_cls_classify(spark, d):
    c = poses.classify(poses.tracked(frames(spark, d)))
    return r6(c.select("clip_id", "stroke_type", "confidence", F.col("features")["side"].alias("side")), "confidence", "side")


def d_cf_confidence(spark, d):
    return r6(poses.confidence_block(poses.tracked(frames(spark, d))), "pose_confidence", "hidden")


def d_root_stroke_root(spark, d):
    f = frames(spark, d)
    t = poses.tracked(f)
    return poses.stroke_root(poses.keyframes(t), poses.confidence_block(t), poses.quality(f))


QUERIES = {f.__name__: f for f in (prj2_landmark_pick, prj3_uncrop, prj6_visibility_flag, sc1_geometry, sc2_centre_of_mass, ag11_motion_energy, wn30_rotation_proxy, wn31_ready_frames, d_cal_calibration, wn32_scale_series, d_vq_quality, d_kf_keyframes, d_cls_classify, d_cf_confidence, d_root_stroke_root)}

_W = "window w as (partition by clip_id order by frame)"
_WIDE = "wide as (select clip_id, frame, any_value(t_ms) as t_ms, max(vis) as vmax, " + ", ".join(f"max(case when lm_id = {i} then {a} end) as {c}{i}" for i in poses.USED for a, c in (("x", "x"), ("y", "y"), ("z", "z"), ("vis", "v"))) + ", row_number() over (partition by clip_id order by frame) - 1 as i, count(*) over (partition by clip_id) as n from pose group by clip_id, frame)"
_CORE = "(" + " + ".join(f"v{i}" for i in B.CORE) + ") / 12"


def _g(c: str) -> str:
    return f"(coalesce(lead({c}) over w, {c}) - coalesce(lag({c}) over w, {c})) / (coalesce(lead(t_ms) over w, t_ms) - coalesce(lag(t_ms) over w, t_ms)) * 1000"


def _speed(i: int) -> str:
    return f"sqrt(({_g(f'x{i}')}) ** 2 + ({_g(f'y{i}')}) ** 2)"


_BASE = f"{duck('pose')}, {_WIDE}"
_EN = f"en as (select *, {' + '.join(_speed(i) for i in B.UPPER)} as energy from wide {_W})"
_ROT = "rr as (select *, abs(x12 - x11) / (abs(x24 - x23) + 1e-9) as ratio from wide), rot as (select rr.*, greatest(0::DOUBLE, least(1::DOUBLE, 1 - ratio / (p + 1e-9))) as rot from rr join (select clip_id, quantile_cont(ratio, 0.9) as p from rr group by clip_id) using (clip_id))"
_READY = f"{_EN}, half as (select * from en where i < n // 2), ready as (select half.* from half join (select clip_id, quantile_cont(energy, 0.3) as p from half group by clip_id) using (clip_id) where energy <= p)"
_TURN = "degrees(atan2(z{b} - z{a}, abs(x{b} - x{a}) + 1e-9))"
_SH, _HP = _TURN.format(a=11, b=12), _TURN.format(a=23, b=24)
_ASPECT = "(960::DOUBLE / 540)"
_TRUNK = f"sqrt((((x11 + x12) / 2 - (x23 + x24) / 2) * {_ASPECT}) ** 2 + ((y11 + y12) / 2 - (y23 + y24) / 2) ** 2)"
_CAL = f"""{_READY}, rolls as (select clip_id, degrees(atan2(y28 - y27, (x28 - x27) * {_ASPECT} + 1e-9)) as r from ready union all select clip_id, degrees(atan2(((x11 + x12) / 2 - (x23 + x24) / 2) * {_ASPECT}, (y23 + y24) / 2 - (y11 + y12) / 2 + 1e-9)) from ready),
heights as (select clip_id, abs(median((y27 + y28) / 2) - median(y0)) + 1e-9 as height from wide group by clip_id),
cal0 as (select clip_id, median({_SH}) as shoulder_zero, median({_HP}) as hip_zero, median({_TRUNK}) + 1e-9 as trunk, count(*) as ready_frames from ready group by clip_id),
cal as (select cal0.*, height, roll_deg, abs(shoulder_zero) as deviation_deg from cal0 join (select clip_id, median(r) as roll_deg from rolls group by clip_id) using (clip_id) join heights using (clip_id))"""
_KF = f"""{_ROT}, v0 as (select *, {_speed(16)} as v1, x16 - (x23 + x24) / 2 as hx, y16 - (y23 + y24) / 2 as hy, abs(x27 - x28) as st from rot {_W}),
v2 as (select *, abs(hx) as dx, sqrt(hx ** 2 + hy ** 2) as dd, lag(v1) over w as va, lead(v1) over w as vb, lead(t_ms) over w as tb, case when i < greatest(1, floor(n * 0.15::DOUBLE)) or i >= n - greatest(1, floor(n * 0.15::DOUBLE)) then 0 else v1 end as v from v0 {_W}),
ht as (select clip_id, abs(median((y27 + y28) / 2) - median((y11 + y12) / 2)) + 1e-9 as tall from wide group by clip_id),
v as (select v2.*, tall, coalesce(case when abs(va - 2 * v1 + vb) >= 1e-12 then t_ms + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (va - vb) / (va - 2 * v1 + vb))) * (tb - t_ms) end, t_ms) as fine from v2 join ht using (clip_id)),
imp as (select clip_id, i as impact, t_ms as ti, fine as impact_ms from (select *, row_number() over (partition by clip_id order by v desc, i) as k from v) where k = 1 and v > 0),
bk as (select clip_id, i as backswing_peak from (select v.clip_id, v.i, dx, row_number() over (partition by v.clip_id order by dx desc, v.i) as k from v join imp using (clip_id) where v.i < impact and impact > 2) where k = 1 and dx > 0.02),
tt as (select v.*, max(rot) over (partition by v.clip_id) as top from v join bk using (clip_id) where v.i < backswing_peak and backswing_peak > 1),
ut as (select clip_id, min(i) as unit_turn from tt where top > 0.05 and rot >= 0.3::DOUBLE * top group by clip_id),
fo as (select clip_id, i as follow_through_peak from (select v.clip_id, v.i, row_number() over (partition by v.clip_id order by dd desc, v.i) as k, count(*) over (partition by v.clip_id) as c from v join imp using (clip_id) where v.t_ms > ti and v.t_ms <= ti + 1000) where k = 1 and c >= 2),
ea as (select clip_id, avg(hx) as rx, avg(hy) as ry, avg(st) as rs from v where i < greatest(2, floor(n * 0.1::DOUBLE)) group by clip_id),
rd as (select *, sum((sqrt((hx - rx) ** 2 + (hy - ry) ** 2) / tall < 0.12 and abs(st - rs) / tall < 0.12)::INT) over (partition by clip_id order by i rows between current row and 2 following) as run from v join ea using (clip_id) join fo using (clip_id) where i > follow_through_peak),
rr3 as (select clip_id, min(i) as ready_restored from rd where run = 3 group by clip_id),
kf as (select c.clip_id, unit_turn, backswing_peak, impact, impact_ms, follow_through_peak, ready_restored from (select distinct clip_id from wide) c left join imp using (clip_id) left join bk using (clip_id) left join ut using (clip_id) left join fo using (clip_id) left join rr3 using (clip_id))"""
_CF = f"""jm as (select *, greatest({', '.join(f"sqrt((x{i} - lag(x{i}) over w) ** 2 + (y{i} - lag(y{i}) over w) ** 2)" for i in B.CORE)}) as jump, {_CORE} as core from wide {_W}),
cf as (select clip_id, round(avg(core) filter (where impact is null or (i >= coalesce(unit_turn, 0) and i <= coalesce(follow_through_peak, n))), 2) as pose_confidence, avg((core < 0.5)::INT::DOUBLE) as hidden, coalesce(max(jump), 0) < 0.08::DOUBLE * greatest(max(tall), 1e-6) * 3 as clean from jm join kf using (clip_id) join ht using (clip_id) group by clip_id)"""
_UPV = "(" + " + ".join(f"v{i}" for i in B.UPPER) + ") / 6"
_UPX = ", ".join(f"x{i}" for i in B.UPPER)
_VQ = f"""qa as (select clip_id, avg({_UPV}) as visibility, avg((least({_UPX}) < 0.04 or greatest({_UPX}) > 0.96)::INT::DOUBLE) as near_edge, avg((vmax > 0.3)::INT::DOUBLE) as seen, count(*) as frames, avg(energy) filter (where i < side) as head, avg(energy) filter (where i >= n - side) as tail, max(energy) as peak
  from (select *, greatest(2, floor(n * 0.08::DOUBLE)) as side from en) group by clip_id),
vq as (select clip_id, concat_ws(';', case when visibility < 0.5 then 'partial_occlusion' end, case when near_edge > 0.25 then 'player_near_edge' end, case when peak > 0 and (head > 0.5 * peak or tail > 0.5 * peak) then 'partial_swing' end) as issues,
  case when head > 0.5 * peak and tail > 0.5 * peak then 'multiple' when head > 0.5 * peak then 'backswing_cut' when tail > 0.5 * peak then 'follow_through_cut' end as swing_cut, seen > 0.5 and frames >= 15 as usable, visibility, near_edge from qa)"""
_PICK = "max(case when i = {k} then {v} end)"


def _pick(k: str, v: str) -> str:
    return _PICK.format(k=k, v=v)


_CONF = "greatest(0.5::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + abs({m}) / {s}::DOUBLE * 0.45::DOUBLE))"
_CLS = f"""q0 as (select *, x16 - ((x11 + x12) / 2 + (x23 + x24) / 2) / 2 as off from v join kf using (clip_id)),
q as (select clip_id, median(y0) - min(y16) filter (where i between impact - 5 and impact + 5) as overhead, max(abs(off)) filter (where i < impact) / max(tall) as amp, max(case when i = coalesce(backswing_peak, greatest(0, impact - 5)) then off end) as side,
  degrees(atan2({_pick('backswing_peak', 'y16')} - {_pick('impact', 'y16')}, abs({_pick('impact', 'x16')} - {_pick('backswing_peak', 'x16')}) + 1e-9)) as path, max(tall) as tall, max(impact) as impact from q0 group by clip_id),
s as (select *, greatest(0.5::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + abs(side) / (0.25::DOUBLE * tall) * 0.45::DOUBLE)) as sure_side, coalesce(side > 0, false) as fore from q),
cls as (select clip_id, case when impact is null then 'FH' when overhead > 0.03 then 'SV' when amp < 0.35 then 'VL' when not fore and path < -15 then 'SL' when fore then 'FH' else 'BH' end as stroke_type,
case when impact is null then 0.5 when overhead > 0.03 then {_CONF.format(m='(overhead - 0.03::DOUBLE)', s='0.15')} when amp < 0.35 then {_CONF.format(m='(0.35::DOUBLE - amp)', s='0.2')} when not fore and path < -15 then least(sure_side, {_CONF.format(m='(-15 - path)', s='20')}) else sure_side end as confidence, side from s)"""
_COM = "(((x11 + x12) / 2 + (x23 + x24) / 2) / 2 * 0.5::DOUBLE + " + " + ".join(f"(x{a} + x{b}) / 2 * {m}::DOUBLE" for a, b, m in B.SEGMENTS) + ")"
_ELBOW = "degrees(acos(greatest(-1::DOUBLE, least(1::DOUBLE, ((x12 - x14) * (x16 - x14) + (y12 - y14) * (y16 - y14)) / (sqrt((x12 - x14) ** 2 + (y12 - y14) ** 2) * sqrt((x16 - x14) ** 2 + (y16 - y14) ** 2))))))"
_rd = lambda *n: ", ".join(f"round({x}, 6) as {x}" for x in n)
ORACLE_SQL = {
    "prj2_landmark_pick": f"{_BASE} select clip_id, frame, round(x16, 6) as wrist_x, round((y23 + y24) / 2, 6) as hip_y from wide",
    "prj3_uncrop": f"{duck('pose')} select clip_id, lm_id, frame, round((x * 200 + 100) / 960, 6) as fx, round((y * 300 + 50) / 540, 6) as fy from pose where lm_id < 4",
    "prj6_visibility_flag": f"{_BASE}, f as (select clip_id, case when {_CORE} >= 0.8 then 'visible' when {_CORE} >= 0.5 then 'low_confidence' else 'not_detectable' end as flag from wide) select clip_id, flag, case when flag = 'visible' then 'low_confidence' else flag end as capped, count(*) as n from f group by all",
    "sc1_geometry": f"""{_BASE} select clip_id, frame, round({_ELBOW}, 6) as elbow, round({_SH}, 6) as turn, round(degrees(atan2(y12 - y11, x12 - x11)) - floor(degrees(atan2(y12 - y11, x12 - x11)) / 180) * 180, 6) as line,
round((x23 + x24) / 2 + (x16 - (x23 + x24) / 2) * cos(radians(6)) - (y16 - (y23 + y24) / 2) * sin(radians(6)), 6) as rx, round((y23 + y24) / 2 + (x16 - (x23 + x24) / 2) * sin(radians(6)) + (y16 - (y23 + y24) / 2) * cos(radians(6)), 6) as ry from wide""",
    "sc2_centre_of_mass": f"{_BASE} select clip_id, frame, round({_COM}, 6) as x, round({_COM.replace('x', 'y')}, 6) as y from wide",
    "ag11_motion_energy": f"{_BASE}, {_EN} select clip_id, frame, round(energy, 6) as energy from en",
    "wn30_rotation_proxy": f"{_BASE}, {_ROT} select clip_id, frame, round(rot, 6) as rot from rot",
    "wn31_ready_frames": f"{_BASE}, {_READY} select clip_id, frame from ready",
    "d_cal_calibration": f"{_BASE}, {_CAL} select clip_id, ready_frames, {_rd('shoulder_zero', 'hip_zero', 'trunk', 'height', 'roll_deg', 'deviation_deg')}, case when deviation_deg > 30 then 'reject' when deviation_deg > 15 then 'degraded' else 'ok' end as tier, concat_ws(';', case when deviation_deg > 30 then 'side_view' end, case when abs(roll_deg) > 8 then 'camera_tilted' end) as issues from cal",
    "wn32_scale_series": f"{_BASE}, {_CAL} select wide.clip_id, frame, round(180 / height * greatest(0.5::DOUBLE, least(2::DOUBLE, trunk / case when {_TRUNK} > 1e-6 then {_TRUNK} else trunk end)), 6) as cm from wide join cal using (clip_id)",
    "d_vq_quality": f"{_BASE}, {_EN}, {_VQ} select clip_id, issues, swing_cut, usable, round(visibility, 6) as visibility, round(near_edge, 6) as near_edge from vq",
    "d_kf_keyframes": f"{_BASE}, {_KF} select clip_id, " + ", ".join(f"{k}::DOUBLE as {k}" for k in poses.KEYFRAMES) + ", round(impact_ms, 6) as impact_ms from kf",
    "d_cls_classify": f"{_BASE}, {_KF}, {_CLS} select clip_id, stroke_type, round(confidence, 6) as confidence, round(side, 6) as side from cls",
    "d_cf_confidence": f"{_BASE}, {_KF}, {_CF} select clip_id, round(pose_confidence, 6) as pose_confidence, round(hidden, 6) as hidden, clean from cf",
    "d_root_stroke_root": f"""{_BASE}, {_EN}, {_VQ}, {_KF}, {_CF}, j as (select clip_id, issues, pose_confidence, (unit_turn is not null)::INT + (backswing_peak is not null)::INT + (impact is not null)::INT + (follow_through_peak is not null)::INT as swing, ready_restored is not null as ready from kf join cf using (clip_id) join vq using (clip_id)),
r as (select *, case when swing = 4 and ready then 'valid' when swing = 0 then 'failed' else 'partial' end as status, swing = 4 and issues = '' as is_clean from j)
select clip_id, status, is_clean, case when status = 'failed' or pose_confidence < 0.6 then 'discard' when status = 'partial' or not is_clean or pose_confidence < 0.85 then 'coach_review' else 'auto_accept' end as action from r""",
}
