"""Registered queries of the metric blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metric_blocks as M
from . import poses as P
from .series import r6


def _measured(spark, d):
    return M.measured(P.frames(spark, d))


def _rounded(df):
    return r6(df, *[n for n, t in df.dtypes if t == "double"])


def m_arm(spark, d):
    return _rounded(M.arm(_measured(spark, d)))


def m_contact(spark, d):
    return _rounded(M.contact(_measured(spark, d)))


def m_movement(spark, d):
    """The movement block, with the split step (WN39) and the crossing of the weight (WN40)."""
    return _rounded(M.movement(_measured(spark, d)))


def d_cls2_light_type(spark, d):
    return M.light_type(P.poses.tracked(P.frames(spark, d)))


def m_light(spark, d):
    return _rounded(M.light(P.poses.tracked(P.frames(spark, d))))


QUERIES = {f.__name__: f for f in (m_arm, m_contact, m_movement, d_cls2_light_type, m_light)}

_p = P._pick
_TORSO = "((x11 + x12) / 2 + (x23 + x24) / 2) / 2"
_DOT = "((x12 - x14) * (x16 - x14) + (y12 - y14) * (y16 - y14) + (z12 - z14) * (z16 - z14))"
_LEN = "(sqrt((x12 - x14) ** 2 + (y12 - y14) ** 2 + (z12 - z14) ** 2) * sqrt((x16 - x14) ** 2 + (y16 - y14) ** 2 + (z16 - z14) ** 2))"
_ELBOW3 = f"degrees(acos(greatest(-1::DOUBLE, least(1::DOUBLE, {_DOT} / {_LEN}))))"
_DEPTH = "degrees(atan2(abs(x16 - x12), y16 - y12 + 1e-9))"
_MEASURED = f"""{P._BASE}, {P._CAL}, {P._KF}, {P._CLS},
rear as (select clip_id, median(z27) < median(z28) as is_left from wide group by clip_id),
sc0 as (select v.*, stroke_type, unit_turn, backswing_peak, impact, impact_ms, follow_through_peak, ready_restored, {P._COM} as com_x, {P._COM.replace('x', 'y')} as com_y,
  170 / height * greatest(0.5::DOUBLE, least(2::DOUBLE, trunk / case when {P._TRUNK} > 1e-6 then {P._TRUNK} else trunk end)) as cm, case when is_left then x27 else x28 end as xr, case when is_left then x28 else x27 end as xf
  from v join kf using (clip_id) join cls using (clip_id) join cal using (clip_id) join rear using (clip_id)),
ms as (select sc0.*, cm_mid, base27, base28, case when abs(xf - xr) < 1e-6 then 50 else greatest(0::DOUBLE, least(1::DOUBLE, 1 - (com_x - xr) / (xf - xr))) * 100 end as load
  from sc0 join (select clip_id, median(cm) as cm_mid, median(y27) filter (where i < unit_turn) as base27, median(y28) filter (where i < unit_turn) as base28 from sc0 group by clip_id) using (clip_id))"""
_CON = f"""con as (select clip_id, any_value(stroke_type) as stroke_type, {_p('impact', '((y27 + y28) / 2 - y16) * cm')} as contact_height_cm, {_p('impact', f'(x16 - {_TORSO}) * cm')} as contact_distance_cm,
  case when any_value(stroke_type) not in ('VL', 'SV') then degrees(atan2({_p('backswing_peak', 'y16')} - {_p('impact', 'y16')}, abs({_p('impact', 'x16')} - {_p('backswing_peak', 'x16')}) + 1e-9)) end as swing_path_deg from ms group by clip_id)"""
_MOV = f"""mv0 as (select clip_id, any_value(stroke_type) as st, any_value(unit_turn) as turn, {_p('unit_turn', 't_ms')} as turn_ms, list(t_ms order by i) filter (where i < unit_turn and base27 - y27 > 0.015::DOUBLE * tall and base28 - y28 > 0.015::DOUBLE * tall) as up,
  sqrt(({_p('impact', 'com_x')} - max(case when i = 0 then com_x end)) ** 2 + ({_p('impact', 'com_y')} - max(case when i = 0 then com_y end)) ** 2) * any_value(cm_mid) as moved, ({_p('impact', 't_ms')} - max(case when i = 0 then t_ms end)) / 1000 as seconds,
  {_p('impact', 'abs(x28 - x27) * cm')} as stance_width_cm, {_p('impact', 'degrees(atan2(abs(z28 - z27), abs(x28 - x27) + 1e-9))')} as stance_angle_deg,
  min_by(t_ms, i) filter (where impact > backswing_peak and i between backswing_peak and impact and load < 50) - any_value(impact_ms) as weight_timing_ms,
  {_p('backswing_peak', 'load')} as rear0, case when any_value(backswing_peak) is not null then 100 - {_p('impact', 'load')} end as front0, {_p('ready_restored', 't_ms')} - {_p('follow_through_peak', 't_ms')} as recovery_ms,
  (any_value(ready_restored) - any_value(follow_through_peak))::DOUBLE as recovery_frames, {_p('ready_restored', 'com_x')} as zone from ms group by clip_id),
mov as (select *, case when st <> 'SV' and turn >= 3 then coalesce(len(up), 0) >= 2 end as split_step, case when st <> 'VL' then rear0 end as rear_load_pct, case when st <> 'VL' then front0 end as front_transfer_pct from mv0)"""
ORACLE_SQL = {
    "m_arm": f"""{_MEASURED} select clip_id, round(case when any_value(stroke_type) <> 'SV' then {_p('follow_through_peak', _ELBOW3)} end, 6) as follow_through_angle_deg,
round(case when any_value(stroke_type) <> 'SV' then {_p('backswing_peak', f'case when x16 - {_TORSO} > 0 then -{_DEPTH} else {_DEPTH} end')} end, 6) as backswing_depth_deg from ms group by clip_id""",
    "m_contact": f"{_MEASURED}, {_CON} select clip_id, round(contact_height_cm, 6) as contact_height_cm, round(contact_distance_cm, 6) as contact_distance_cm, round(swing_path_deg, 6) as swing_path_deg from con",
    "m_movement": f"""{_MEASURED}, {_MOV} select clip_id, split_step, round(case when split_step then up[len(up) // 2 + 1] - turn_ms end, 6) as split_step_ms, round(case when st <> 'SV' then moved end, 6) as footwork_cm,
round(case when st <> 'SV' and seconds > 0 then moved / 100 / seconds end, 6) as speed_mps, round(stance_width_cm, 6) as stance_width_cm, round(stance_angle_deg, 6) as stance_angle_deg, round(weight_timing_ms, 6) as weight_timing_ms,
round(rear_load_pct, 6) as rear_load_pct, round(front_transfer_pct, 6) as front_transfer_pct, round(recovery_ms, 6) as recovery_ms, recovery_frames,
case when zone is null then 'not_recovered' when zone < 0.4 then 'baseline_left' when zone > 0.6 then 'baseline_right' else 'baseline_center' end as recovery_position from mov""",
    "d_cls2_light_type": f"""{P._BASE}, {P._KF}, k as (select clip_id, case when least(v0, v11, v12, v16) < 0.3 then 'FH' when y16 < y0 - 0.05 then 'SV' when x16 > (x11 + x12) / 2 then 'FH' else 'BH' end as kind from v join kf using (clip_id) where i = impact)
select c.clip_id, coalesce(kind, 'FH') as stroke_type from (select distinct clip_id from wide) c left join k using (clip_id)""",
    "m_light": f"""{P._BASE}, {P._KF}, l0 as (select v.*, unit_turn, backswing_peak, impact, follow_through_peak, case when v27 > 0.3 and v28 > 0.3 then (y27 + y28) / 2 when v27 > 0.3 then y27 when v28 > 0.3 then y28 end as ground from v join kf using (clip_id)),
l as (select *, case when v0 >= 0.3 and abs(ground - y0) >= 1e-6 then 170 / abs(ground - y0) end as cm, degrees(atan2(y12 - y11, x12 - x11)) as sturn, degrees(atan2(y24 - y23, x24 - x23)) as hturn, case when {_LEN} < 1e-12 then 0 else {_ELBOW3} end as el from l0)
select clip_id, round(case when any_value(impact) is not null then {_p('unit_turn', 'sturn')} end, 6) as shoulder_turn_deg, round(case when any_value(impact) is not null then {_p('unit_turn', 'hturn')} end, 6) as hip_turn_deg,
round({_p('impact', 'sturn')}, 6) as shoulder_impact_deg, round({_p('impact', 'hturn')}, 6) as hip_impact_deg, round({_p('impact', 'sturn - hturn')}, 6) as separation_deg, round(case when any_value(impact) is not null then {_p('follow_through_peak', 'el')} end, 6) as follow_through_angle_deg,
round(case when any_value(impact) is not null then {_p('backswing_peak', 'el')} end, 6) as backswing_depth_deg, round({_p('impact', 'case when v16 > 0.3 then abs(ground - y16) * cm end')}, 6) as contact_height_cm,
round({_p('impact', f'case when v16 > 0.3 then sqrt((x16 - {_TORSO}) ** 2 + (y16 - {_TORSO.replace("x", "y")}) ** 2) * cm end')}, 6) as contact_distance_cm from l group by clip_id""",
}
