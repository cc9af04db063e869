"""Registered queries of the metric engine: all metrics with their flags, block by block, and the null rule, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stroke_metrics as M
from ..sources.adapters import duck, view
from ..sources.scratch import stored
from . import poses as P
from .metric_blocks import _MEASURED
from .series import r6


def _rows(spark, d):
    """Every metric of every clip; the ball table of the clip's number stands in for a ball tracked in the same picture."""
    ball = view(spark, d, "boxes").filter("class = 'ball'").groupBy("clip_id", "frame").agg(F.min_by("x", "box_key").alias("x"))
    ball = ball.withColumn("x", F.when(F.col("x") < 700, F.col("x")))
    frames = stored(P.frames(spark, d), "frames")
    # stored, for the optimizer writes out the array of all metrics for each condition on a row of it
    return M.long(stored(M.engine(stored(M.enriched(frames), "tracked"), ball=ball), "metrics"))


def cj2_metrics(spark, d):
    return r6(_rows(spark, d), "value")


def _block(name: str, block: str):
    def query(spark, d):
        return r6(_rows(spark, d).filter(F.col("block") == block).drop("block"), "value")

    query.__name__ = name
    return query


BLOCKS = {"m_body": "body", "m_timing": "timing", "m_depth": "depth_estimated", "m_kin": "kinematics", "m_specific": "stroke_specific", "m_ball": "ball", "m_derived": "derived"}


def d_null_rule(spark, d):
    """Values that stand beside ``not_detectable``, because their landmarks are hidden; nothing else may break the rule."""
    return M.null_breaches(_rows(spark, d)).groupBy("block", "metric", "breach").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (cj2_metrics, d_null_rule, *(_block(n, b) for n, b in BLOCKS.items()))}

_D3 = "(sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2 + (z{a} - z{b}) ** 2) * sqrt((x{c} - x{b}) ** 2 + (y{c} - y{b}) ** 2 + (z{c} - z{b}) ** 2) + 1e-9)"
_DOT = "((x{a} - x{b}) * (x{c} - x{b}) + (y{a} - y{b}) * (y{c} - y{b}) + (z{a} - z{b}) * (z{c} - z{b}))"


def _ang(a: int, b: int, c: int) -> str:
    return f"degrees(acos(greatest(-1::DOUBLE, least(1::DOUBLE, {_DOT.format(a=a, b=b, c=c)} / {_D3.format(a=a, b=b, c=c)}))))"


def _mean(*lm: int) -> str:
    return "(" + " + ".join(f"v{i}" for i in lm) + f") / {len(lm)}"


_LEAN = "abs(degrees(atan2((x11 + x12) / 2 - (x23 + x24) / 2, (y23 + y24) / 2 - (y11 + y12) / 2 + 1e-9)))"
_ROW = {
    "t": "t_ms", "cm": "cm", "sh": "sh", "hp": "hp", "cx": "com_x", "cy": "com_y", "load": "load", "torso": "((x11 + x12) / 2 + (x23 + x24) / 2) / 2", "elbow": _ang(12, 14, 16), "wrist": _ang(14, 16, 20), "knee": _ang(24, 26, 28),
    "spine": f"case when (z11 + z12) / 2 - (z23 + z24) / 2 < 0 then {_LEAN} else -{_LEAN} end", "wx": "x16", "wy": "y16", "sx": "x12", "sy": "y12", "ex": "x14", "ey": "y14", "ear": "x8", "fx": "(x27 + x28) / 2", "fy": "(y27 + y28) / 2",
    "stance": "abs(x28 - x27)", "sdeg": "degrees(atan2(abs(z28 - z27), abs(x28 - x27) + 1e-9))", "v_sh": _mean(11, 12), "v_hip": _mean(23, 24), "v_trunk": _mean(11, 12, 23, 24), "v_nose": "v0", "v_arm": _mean(12, 14, 16), "v_wrist": "v16",
    "v_hand": _mean(16, 20), "v_ear": _mean(16, 8), "v_feet": _mean(27, 28), "v_body": _mean(11, 12, 23, 24, 25, 26), "v_leg": _mean(24, 26, 28), "lx": "lag(com_x) over w", "ly": "lag(com_y) over w", "lt": "lag(t_ms) over w",
}
_SLOPE = "abs((coalesce(lead({0}) over (partition by clip_id order by i), {0}) - coalesce(lag({0}) over (partition by clip_id order by i), {0})) / (coalesce(lead(t_ms) over (partition by clip_id order by i), t_ms) - coalesce(lag(t_ms) over (partition by clip_id order by i), t_ms)) * 1000)"
_ENGINE = f"""{_MEASURED},
e0 as (select ms.*, {P._SH} - shoulder_zero as sh, {P._HP} - hip_zero as hp from ms join (select clip_id, shoulder_zero, hip_zero from cal) z using (clip_id)),
e1 as (select e0.*, {{{", ".join(f"'{k}': {v}" for k, v in _ROW.items())}}} as r from e0 window w as (partition by clip_id order by i)),
sl as (select clip_id, i, t_ms, {_SLOPE.format('sh')} as vs, {_SLOPE.format('hp')} as vh from e0 where i between backswing_peak and impact and impact > backswing_peak),
nose as (select clip_id, x0 as nx, y0 as ny from e0 where i = impact),
k as (select clip_id, any_value(stroke_type) as kind, any_value(impact) as f3, any_value(unit_turn) as f1, any_value(ready_restored) - any_value(follow_through_peak) as restored, any_value(impact_ms) as ti, any_value(cm_mid) as cm_mid, any_value(tall) as tall,
  {", ".join(f"any_value(r) filter (where i = {name}) as {b}" for b, name in M.POINTS.items())}, any_value(r) filter (where i = 0) as b0,
  max(sqrt((x0 - nx) ** 2 + (y0 - ny) ** 2)) filter (where abs(i - impact) <= 5) as head, list(t_ms order by i) filter (where i < unit_turn and base27 - y27 > 0.015::DOUBLE * tall and base28 - y28 > 0.015::DOUBLE * tall) as up,
  max(v1) filter (where i between backswing_peak and impact and impact > backswing_peak) as fastest, max(y16) filter (where i between backswing_peak and impact) as lowest,
  min_by(t_ms, i) filter (where i between backswing_peak and impact and impact > backswing_peak and load < 50) as crossed from e1 left join nose using (clip_id) group by clip_id),
tops as (select clip_id, max(vs) as top_s, max(vh) as top_h, arg_max(t_ms, vs order by i) as at_s, arg_max(t_ms, vh order by i) as at_h from (select clip_id, i, t_ms, vs, vh from sl) group by clip_id),
bl as (select clip_id, avg((x < 700)::INT::DOUBLE) as tracked from (select clip_id, frame, min_by(x, box_key) as x from boxes where class = 'ball' group by all) group by clip_id),
c as (select k.*, tops.* exclude (clip_id), tracked, case when kind = 'BH' then -1 else 1 end as flip, b2.t - b1.t as back0, ti - b2.t as ahead, (b3.fy - b3.wy) * b3.cm as height, (b3.wx - b3.torso) * b3.cm as reach, b2.wy - b3.wy as rise,
  case when kind not in ('VL', 'SV') then degrees(atan2(b2.wy - b3.wy, abs(b3.wx - b2.wx) + 1e-9)) end as path, crossed - ti as offset_ms, case when kind <> 'VL' then b2.load end as rear, case when kind <> 'VL' and b2 is not null then 100 - b3.load end as front,
  sqrt((b3.cx - b2.cx) ** 2 + (b3.cy - b2.cy) ** 2) * b3.cm as shift, abs(b3.cx - b3.fx) * b3.cm as off3, abs(b4.cx - b4.fx) * b4.cm as off4, case when kind <> 'SV' then sqrt((b3.cx - b0.cx) ** 2 + (b3.cy - b0.cy) ** 2) * cm_mid end as moved, (b3.t - b0.t) / 1000 as seconds,
  case when kind <> 'SV' and f1 >= 3 then coalesce(len(up), 0) >= 2 end as split, degrees(atan2(abs(b2.wx - b2.sx), b2.wy - b2.sy + 1e-9)) as deep, abs(degrees(atan2(b2.sy - b2.ey, abs(b2.ex - b2.sx) + 1e-9))) as upper
  from k left join tops using (clip_id) left join bl using (clip_id)),
d as (select *, case when kind <> 'VL' then back0 end as back, case when kind <> 'VL' and back0 <> 0 and ahead > 0 then back0 / ahead end as tempo from c)"""


def _see(point: str, what: str, cap: bool = False) -> str:
    v = f"{point}.v_{what}"
    return f"case when {v} >= 0.8 then '{'low_confidence' if cap else 'visible'}' when {v} >= 0.5 then 'low_confidence' else 'not_detectable' end"


_V, _L, _H = "'visible'", "'low_confidence'", "'not_detectable'"
# (block, metric, number or none, text or none, flag or none where derived, condition or none)
_TABLE: list[tuple] = [
    ("body", "body_height_cm", "170", None, _L, None), ("body", "arm_span_cm", "170", None, _L, None),
    *[("body", f"{part}_rotation_at_{when}_deg", f"flip * {b}.{f}", None, _see(b, v), None) for part, f, v in (("shoulder", "sh", "sh"), ("hip", "hp", "hip")) for b, when in (("b1", "unit_turn"), ("b3", "impact"))],
    ("body", "shoulder_rotation_normalized_pct", "flip * b3.sh", None, _see("b3", "sh"), None), ("body", "shoulder_hip_separation_at_impact_deg", "flip * b3.sh - flip * b3.hp", None, _see("b3", "trunk"), None),
    ("body", "head_still_at_contact", None, "(head * b3.cm < 5.1)", _see("b3", "nose"), None),
    ("arm", "follow_through_angle_deg", "case when kind <> 'SV' then b4.elbow end", None, _see("b4", "arm"), None), ("arm", "backswing_depth_deg", "case when kind <> 'SV' then case when b2.wx - b2.torso > 0 then -deep else deep end end", None, _see("b2", "arm"), None),
    ("timing", "backswing_duration_ms", "back", None, _V, None), ("timing", "forward_swing_duration_ms", "ahead", None, _V, None), ("timing", "total_swing_duration_ms", "ti - b1.t", None, _V, None), ("timing", "tempo_ratio", "tempo", None, _V, None),
    ("timing", "rhythm_class", None, "case when tempo < 1.5 then 'rushed' when tempo <= 3 then 'balanced' when tempo is not null then 'slow' end", None, None),
    ("contact", "contact_height_cm", "height", None, _see("b3", "wrist"), None), ("contact", "contact_distance_from_body_cm", "reach", None, _see("b3", "wrist"), None), ("contact", "swing_path_angle_deg", "path", None, _see("b3", "wrist"), None),
    ("movement", "split_step_detected", None, "split", _V, None), ("movement", "split_step_timing_ms", "case when split then up[len(up) // 2 + 1] - b1.t end", None, _V, None), ("movement", "footwork_distance_cm", "moved", None, _V, None),
    ("movement", "movement_speed_mps", "case when seconds > 0 then moved / 100 / seconds end", None, _V, None), ("movement", "stance_width_at_impact_cm", "b3.stance * b3.cm", None, _see("b3", "feet"), None), ("movement", "stance_angle_deg", "b3.sdeg", None, _see("b3", "feet"), None),
    ("movement", "weight_transfer_timing_offset_ms", "offset_ms", None, _see("b3", "hip", True), None), ("movement", "rear_leg_load_pct", "rear", None, _see("b2", "feet", True), None), ("movement", "front_leg_transfer_pct", "front", None, _see("b3", "feet", True), None),
    ("movement", "recovery_time_ms", "b5.t - b4.t", None, _V, None), ("movement", "return_to_ready_frames", "restored", None, _V, None),
    ("movement", "recovery_position", None, "case when b5 is null then 'not_recovered' when b5.cx < 0.4 then 'baseline_left' when b5.cx > 0.6 then 'baseline_right' else 'baseline_center' end", _V, None),
    ("depth_estimated", "elbow_angle_at_impact_deg", "b3.elbow", None, _see("b3", "arm", True), None), ("depth_estimated", "elbow_angle_at_backswing_peak_deg", "b2.elbow", None, _see("b2", "arm", True), None),
    ("depth_estimated", "wrist_angle_at_impact_deg", "b3.wrist", None, _see("b3", "hand", True), None), ("depth_estimated", "spine_tilt_at_impact_deg", "b3.spine", None, _see("b3", "trunk", True), None),
    ("depth_estimated", "com_shift_distance_cm", "shift", None, _see("b3", "body", True), None), ("depth_estimated", "com_deviation_at_impact_cm", "off3", None, _see("b3", "feet", True), None), ("depth_estimated", "com_deviation_at_finish_cm", "off4", None, _see("b4", "feet", True), None),
    ("depth_estimated", "pronation_detected", None, None, _H, None), ("depth_estimated", "racket_face_open_deg", None, None, _H, None),
    ("depth_estimated", "peak_racket_drop_cm", "case when kind not in ('SL', 'VL', 'RS') then greatest(0::DOUBLE, lowest - b2.wy) * b3.cm + 0 * b2.wy end", None, _see("b3", "wrist", True), None),
    ("kinematics", "hip_rotation_velocity_deg_s", "top_h", None, _L, None), ("kinematics", "shoulder_rotation_velocity_deg_s", "top_s", None, _L, None), ("kinematics", "hip_shoulder_velocity_lag_ms", "at_s - at_h", None, _L, None),
    ("kinematics", "center_of_mass_velocity_mps", "case when b3.t > b3.lt then sqrt((b3.cx - b3.lx) ** 2 + (b3.cy - b3.ly) ** 2) * b3.cm / 100 / ((b3.t - b3.lt) / 1000) end", None, _V, None),
    ("kinematics", "racket_tip_position", None, None, _H, None), ("kinematics", "racket_center_position", None, None, _H, None), ("kinematics", "racket_head_speed_mps", "fastest * b3.cm / 100", None, _L, None),
    ("stroke_specific", "toss_deviation_cm", None, None, _H, "kind = 'SV'"), ("stroke_specific", "trophy_position_achieved", None, "(b2.ey <= b2.sy and upper <= 20 and b2.wy <= b2.sy)", _see("b2", "arm"), "kind = 'SV'"),
    ("stroke_specific", "leg_drive_detected", None, "case when b2 is not null and b3 is not null then b3.knee - b2.knee >= 15 and b3.cy < b2.cy end", _see("b3", "leg"), "kind = 'SV'"), ("stroke_specific", "peak_contact_height_cm", "height", None, _see("b3", "wrist"), "kind = 'SV'"),
    ("stroke_specific", "stance_type", None, "case when b3.stance < 0.5 * b0.stance then 'pinpoint' when b3 is not null then 'platform' end", _see("b3", "feet"), "kind = 'SV'"),
    ("stroke_specific", "backswing_past_ear", None, "(b2.wx - b2.ear > 0)", _see("b2", "ear"), "kind = 'VL'"),
    ("stroke_specific", "hands_height_at_contact", None, "case when height > 101.4 then 'above_net' when height < 81.4 then 'below_net' when height is not null then 'at_net' end", _see("b3", "wrist"), "kind = 'VL'"),
    ("stroke_specific", "punch_forward_detected", None, "case when b3 is not null then -(b4.wx - b3.wx) > 0.02 end", _see("b4", "wrist"), "kind = 'VL'"),
    ("stroke_specific", "swing_direction_verified", None, "case when rise > 0.02::DOUBLE * tall then 'low_to_high' when rise < -0.02::DOUBLE * tall then 'high_to_low' when rise is not null then 'flat' end", _see("b3", "wrist"), "kind = 'SL'"),
    ("ball", "available", None, "(tracked is not null)", _V, None), *[("ball", n, None, None, _H, "tracked is not null") for n in ("ball_speed_kmh", "trajectory_clearance_cm", "landing_position", "landing_zone", "landing_call")],
    ("ball", "tracked_fraction", "tracked", None, _V, "tracked is not null"),
    ("derived", "swing_path_direction", None, "case when path > 15 then 'low_to_high' when path < -15 then 'high_to_low' when path is not null then 'flat' end", None, None),
    ("derived", "center_of_mass_shift", None, "case when shift < 2 then 'neutral' when b3.cy <= b2.cy then 'forward' when shift is not null then 'backward' end", None, None),
    *[("derived", n, None, f"case when {v} < 5 then 'stable' when {v} <= 15 then 'slight_loss' when {v} is not null then 'clear_loss' end", None, None) for n, v in (("balance_at_impact", "off3"), ("balance_at_finish", "off4"))],
    ("derived", "stance_type", None, "case when b3.sdeg < 30 then 'closed' when b3.sdeg < 60 then 'semi_open' when b3 is not null then 'open' end", None, None),
    ("derived", "weight_transfer_timing", None, "case when offset_ms is null then 'none' when offset_ms < -50 then 'pre_impact' when offset_ms > 50 then 'post_impact' else 'at_impact' end", None, None),
    ("derived", "weight_transfer_direction", None, "case when abs(front - rear) < 5 then 'neutral' when front > rear then 'forward' when front - rear is not null then 'backward' end", None, None),
    ("derived", "contact_timing", None, "case when kind = 'SV' then case when b3.elbow >= 160 then 'ideal' when b3.elbow is not null then 'late' end when reach < case kind when 'RS' then 10 else 15 end then 'early' "
     "when reach > case kind when 'SL' then 35 when 'RS' then 30 when 'VL' then 45 else 40 end then 'late' when reach is not null then 'ideal' end", None, None),
    ("derived", "arm_extension_at_impact", None, "case when b3.elbow >= 160 then 'full' when b3.elbow >= 120 then 'partial' when b3.elbow is not null then 'bent' end", None, None),
]


def _entry(block, metric, number, text, flag, only) -> str:
    value = number or text or "null"
    says = "'derived'" if flag is None else f"case when ({value}) is null then 'not_detectable' else {flag} end"
    return f"select clip_id, kind as stroke_type, '{block}' as block, '{metric}' as metric, ({number or 'null'})::DOUBLE as value, ({text or 'null'})::VARCHAR as text, {says} as flag from d" + (f" where {only}" if only else "")


_ALL = f"{_ENGINE}, rows as ({' union all '.join(_entry(*t) for t in _TABLE)})".replace("with ", f"{duck('boxes')}, ", 1)
ORACLE_SQL = {
    "cj2_metrics": f"{_ALL} select clip_id, stroke_type, block, metric, round(value, 6) as value, text, flag from rows",
    **{n: f"{_ALL} select clip_id, stroke_type, metric, round(value, 6) as value, text, flag from rows where block = '{b}'" for n, b in BLOCKS.items()},
    "d_null_rule": f"{_ALL} select block, metric, 'value beside not_detectable' as breach, count(*) as n from rows where flag = 'not_detectable' and (value is not null or text is not null) group by all",
}
