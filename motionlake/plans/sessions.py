"""Registered queries of the session blocks and accuracy reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, sessions
from ..sources.adapters import duck, view
from .series import r6


def strokes(spark, d):
    return view(spark, d, "strokes")


def ag1_by_type(spark, d):
    names = ("mean_shoulder", "sd_shoulder", "mean_tempo", "sd_tempo", "mean_hip", "mean_contact_height", "mean_swing_path", "mean_racket_speed", "mean_recovery", "split_step_rate")
    return sessions.by_type(strokes(spark, d)).withColumns({n: F.round(n, 9) for n in names})


def ag3_session_stats(spark, d):
    return sessions.session_stats(strokes(spark, d))


def ag4_share_of_max(spark, d):
    return r6(sessions.share_of_max(strokes(spark, d), "shoulder_deg", "share").select("session_id", "stroke_index", "share"), "share")


def ag22_action_counts(spark, d):
    return strokes(spark, d).groupBy(sessions.recommended_action(F.col("confidence")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def ag23_consistency(spark, d):
    return r6(sessions.consistency(strokes(spark, d), ["shoulder_deg", "tempo", "recovery_ms"]), "consistency")


def wn33_trend(spark, d):
    return r6(sessions.trend(strokes(spark, d), "shoulder_deg", True), "first", "mid", "last")


def d_tre_trend_block(spark, d):
    return r6(sessions.trend_block(strokes(spark, d)), "consistency").withColumn("fatigue_onset", F.col("fatigue_onset").cast("double"))


def d_pat_pattern_block(spark, d):
    return sessions.pattern_block(strokes(spark, d))


def d_sum_summary_block(spark, d):
    return sessions.summary_block(strokes(spark, d)).withColumn("fatigue_onset", F.col("fatigue_onset").cast("double"))


def cj3_session_summary(spark, d):
    """The flagship: trend, pattern and summary of every session side by side."""
    s = strokes(spark, d)
    b = sessions.blocks(s).withColumn("clean", F.col("n_clean").cast("long")).select("session_id", *sessions.SUMMARY_FIELDS, *sessions.PATTERN_FIELDS)
    out = b.join(sessions.by_type(s).groupBy("session_id").agg(F.sum("n").alias("clean_strokes"), F.avg("mean_tempo").alias("tempo")), "session_id")
    return r6(out, "tempo").withColumn("fatigue_onset", F.col("fatigue_onset").cast("double"))


def flt5_keep_and_number(spark, d):
    k = sessions.keep_and_number(strokes(spark, d))
    return k.select("session_id", "stroke_index", "kept_index", sessions.demote(F.col("action"), F.col("tempo") / 2.5).alias("action"))


def ux1_type_override(spark, d):
    s = strokes(spark, d)
    fixes = s.filter("stroke_index % 10 = 0").select("session_id", "stroke_index", F.lit("SV").alias("stroke_type"))
    return sessions.type_override(s, fixes).groupBy("session_id", "stroke_type").agg(F.count(F.lit(1)).alias("n"))


def snk2_session_documents(spark, d):
    doc = sessions.documents(strokes(spark, d))
    tops = F.element_at("aggregated_metric", 1)
    return doc.select("session_id", F.size("strokes").cast("long").alias("n"), F.element_at("strokes", 1)["stroke_type"].alias("first_type"), tops["stroke_type"].alias("top_type"), tops["n"].alias("top_n"), F.col("pattern.dominant").alias("dominant"), F.col("trend.tempo_trend").alias("tempo_trend"))


def _errors(spark, d):
    prd = view(spark, d, "prd")
    long = prd.select("clip_id", F.explode(F.array(F.struct(F.lit("impact").alias("keyframe"), F.col("impact_ms").alias("timestamp_ms")), F.struct(F.lit("backswing").alias("keyframe"), (F.col("impact_ms") - 300).alias("timestamp_ms")))).alias("k"), "detected")
    return evaluation.keyframe_errors(view(spark, d, "lab").drop("annotator_id"), long.select("clip_id", "detected", "k.*"), 1)


def ag5_keyframe_accuracy(spark, d):
    return r6(evaluation.keyframe_accuracy(_errors(spark, d)), "accuracy", "mae_ms")


def ag6_failures(spark, d):
    return _errors(spark, d).filter("not ok").groupBy("stroke_type", "keyframe", "reason").agg(F.count(F.lit(1)).alias("n"))


def ag7_agreement(spark, d):
    lab = view(spark, d, "lab").withColumn("task", F.col("clip_id") % 4000)
    return r6(evaluation.agreement(lab, "task", "clip_id", ["impact_frame", "backswing_frame"], 20), "agreement")


def ag8_deviation_bins(spark, d):
    rows = _errors(spark, d).filter("keyframe = 'impact'").join(view(spark, d, "prd").select("clip_id", "deviation_deg"), "clip_id")
    return r6(evaluation.accuracy_by_deviation(rows), "accuracy")


def ag9_spotting(spark, d):
    """Every ninth known frame stands in for a labelled segment, a table the driver does not have."""
    s = view(spark, d, "sig").filter("x is not null")
    truth = s.filter("frame % 9 = 0").select("clip_id", F.col("frame").alias("start"), (F.col("frame") + 3).alias("end"))
    return r6(evaluation.spotting(truth, s.filter("x > 60").select("clip_id", F.col("frame").alias("at")), ["clip_id"], 16), "recall", "precision")


def ag27_classification_report(spark, d):
    lab = view(spark, d, "lab").join(view(spark, d, "prd"), "clip_id")
    called = F.when(F.col("deviation_deg") < 30, F.col("stroke_type")).when(F.col("deviation_deg") < 38, "FH").otherwise("BH")
    return r6(evaluation.classification_report(lab.withColumn("called", called), "stroke_type", "called"), "precision", "recall", "f1")


QUERIES = {f.__name__: f for f in (cj3_session_summary, ag1_by_type, ag3_session_stats, ag4_share_of_max, ag5_keyframe_accuracy, ag6_failures, ag7_agreement, ag8_deviation_bins, ag9_spotting, ag22_action_counts, ag23_consistency, ag27_classification_report, wn33_trend, d_tre_trend_block, d_pat_pattern_block, d_sum_summary_block, flt5_keep_and_number, ux1_type_override, snk2_session_documents)}

_BY_TYPE = """bt as (select session_id, stroke_type, count(*) as n, avg(shoulder_deg) as mean_shoulder, stddev_pop(shoulder_deg) as sd_shoulder, avg(tempo) as mean_tempo, stddev_pop(tempo) as sd_tempo, avg(hip_deg) as mean_hip, avg(contact_cm) as mean_contact_height, avg(path_deg) as mean_swing_path, avg(racket_mps) as mean_racket_speed, avg(recovery_ms) as mean_recovery, avg(split_step::INT::DOUBLE) * 100 as split_step_rate
  from strokes where is_clean group by session_id, stroke_type)"""
_POS = "case {0} when 'FH' then 1 when 'BH' then 2 when 'SV' then 3 when 'VL' then 4 when 'SL' then 5 else 6 end"


def _trend(v: str, up: bool) -> str:
    return f"""k_{v} as (select *, row_number() over (partition by session_id order by stroke_index) as i, count(*) over (partition by session_id) as n from strokes where is_clean and {v} is not null),
m_{v} as (select session_id, max(n) as n, avg({v}::DOUBLE) filter (where i <= greatest(1, n // 3)) as first, avg({v}::DOUBLE) filter (where i > greatest(1, n // 3) and i <= n - greatest(1, n // 3)) as mid0, avg({v}::DOUBLE) filter (where i > n - greatest(1, n // 3)) as last from k_{v} group by session_id),
c_{v} as (select *, coalesce(mid0, first) as mid, (last - first) / (abs(first) + 1e-9) as ch, abs(coalesce(mid0, first) - first) / (abs(first) + 1e-9) as mi from m_{v}),
t_{v} as (select session_id, n, first, mid, last, case when n < 3 then 'stable' when abs(ch) < 0.05 and mi > 0.10 then 'volatile' when abs(ch) < 0.05 then 'stable' when ch {'>' if up else '<'} 0 then 'improving' else 'declining' end as trend from c_{v})"""


_CV = "case when count({0}) >= 3 and abs(avg({0})) > 1e-9 then stddev_pop({0}) / abs(avg({0})) end"
_CONS = f"""cv as (select session_id, list_filter([{', '.join(_CV.format(v) for v in ('shoulder_deg', 'tempo', 'recovery_ms'))}], lambda x: x is not null) as l from strokes where is_clean group by session_id),
cons as (select session_id, greatest(0::DOUBLE, least(1::DOUBLE, 1 - list_sum(l) / len(l))) as consistency from cv)"""
_TRE = f"""{_trend('shoulder_deg', True)}, {_trend('tempo', True)}, {_trend('recovery_ms', False)}, {_trend('split_step', True)}, {_CONS},
onset as (select session_id, stroke_index from (select *, row_number() over (partition by session_id order by stroke_index) as i, count(*) over (partition by session_id) as n from strokes where is_clean) where i = n - greatest(1, n // 3) + 1),
tre0 as (select session_id, coalesce(a.trend, 'stable') as shoulder_deg_trend, coalesce(b.trend, 'stable') as tempo_trend, coalesce(c.trend, 'stable') as recovery_ms_trend, coalesce(d.trend, 'stable') as split_step_trend, consistency, o.stroke_index as onset,
  coalesce((a.trend = 'declining')::INT, 0) + coalesce((b.trend = 'declining')::INT, 0) + coalesce((c.trend = 'declining')::INT, 0) + coalesce((d.trend = 'declining')::INT, 0) >= 2 as fatigue
  from t_shoulder_deg a full join t_tempo b using (session_id) full join t_recovery_ms c using (session_id) full join t_split_step d using (session_id) left join cons using (session_id) left join onset o using (session_id)),
tre as (select session_id, shoulder_deg_trend, tempo_trend, recovery_ms_trend, split_step_trend, consistency, fatigue, case when fatigue then onset end::DOUBLE as fatigue_onset from tre0)"""
_PAT = f"""tc as (select session_id, stroke_type, count(*) as c from strokes group by session_id, stroke_type),
dom as (select session_id, stroke_type as dominant from (select *, row_number() over (partition by session_id order by c desc, {_POS.format('stroke_type')}) as k from tc) where k = 1),
runs as (select *, sum((stroke_type in ('FH', 'BH'))::INT) over (partition by session_id order by stroke_index rows between 2 preceding and current row) as run from strokes),
pat as (select session_id, dominant, coalesce(bool_or(run = 3), false) as ground_run, case when count(*) >= 20 then count(*) filter (where stroke_type = 'BH')::DOUBLE / count(*) * 100 < 20 end as avoids_backhand, count(*) as strokes from runs join dom using (session_id) group by session_id, dominant)"""
_SUM = """base as (select session_id, count(*) filter (where is_clean) as clean, avg((confidence < 0.60)::INT::DOUBLE) as low_share from strokes group by session_id),
hi as (select session_id, stroke_index as highlight from (select *, row_number() over (partition by session_id order by confidence desc, stroke_index) as k from strokes where is_clean) where k = 1),
summ as (select session_id, clean, highlight, case when shoulder_deg_trend = 'declining' then 'shoulder_deg' when tempo_trend = 'declining' then 'tempo' when recovery_ms_trend = 'declining' then 'recovery_ms' when split_step_trend = 'declining' then 'split_step' end as primary_issue,
  case when consistency is null then null when round(consistency, 2) < 0.4 or fatigue then 'poor' when round(consistency, 2) < 0.6 then 'fair' when round(consistency, 2) <= 0.8 then 'good' else 'excellent' end as quality,
  coalesce(round(consistency, 2) < 0.4, false) or coalesce(fatigue, false) or low_share > 0.3 as coach_flag, fatigue, fatigue_onset from base left join hi using (session_id) left join tre using (session_id))"""
_ERR = f"""{duck('lab', 'prd')}, long as (select clip_id, stroke_type, fps, 'impact' as keyframe, impact_frame as frame from lab where usable union all select clip_id, stroke_type, fps, 'backswing', backswing_frame from lab where usable),
pl as (select clip_id, detected, 'impact' as keyframe, impact_ms as ts from prd union all select clip_id, detected, 'backswing', impact_ms - 300 from prd),
e as (select l.*, p.detected, case when p.detected then abs(p.ts - l.frame * 1000::DOUBLE / l.fps) end as error_ms from long l left join pl p using (clip_id, keyframe)),
err as (select *, coalesce(error_ms <= 1000::DOUBLE / fps + 1, false) as ok, case when detected is null then 'no prediction' when not detected then 'not detected' when not coalesce(error_ms <= 1000::DOUBLE / fps + 1, false) then 'off' end as reason from e)"""
_S = duck("strokes")
ORACLE_SQL = {
    "ag1_by_type": f"{_S}, {_BY_TYPE} select session_id, stroke_type, n, round(mean_shoulder, 9) as mean_shoulder, round(sd_shoulder, 9) as sd_shoulder, round(mean_tempo, 9) as mean_tempo, round(sd_tempo, 9) as sd_tempo, round(mean_hip, 9) as mean_hip, round(mean_contact_height, 9) as mean_contact_height, round(mean_swing_path, 9) as mean_swing_path, round(mean_racket_speed, 9) as mean_racket_speed, round(mean_recovery, 9) as mean_recovery, round(split_step_rate, 9) as split_step_rate from bt",
    "ag3_session_stats": f"""{_S}, c as (select session_id, stroke_type, count(*) as n, count(*) filter (where is_clean) as clean from strokes group by all)
select session_id, sum(n)::BIGINT as windows, sum(clean)::BIGINT as usable, '{{' || string_agg('"' || stroke_type || '":' || n, ',' order by {_POS.format('stroke_type')}) || '}}' as distribution from c group by session_id""",
    "ag4_share_of_max": f"{_S} select session_id, stroke_index, round(case when max(abs(shoulder_deg)) over (partition by session_id) > 0 then abs(shoulder_deg) / max(abs(shoulder_deg)) over (partition by session_id) * 100 end, 6) as share from strokes",
    "ag22_action_counts": f"{_S} select case when confidence >= 0.85 then 'auto_accept' when confidence >= 0.6 then 'coach_review' else 'discard' end as action, count(*) as n from strokes group by 1",
    "ag23_consistency": f"{_S}, {_CONS} select session_id, round(consistency, 6) as consistency from cons",
    "wn33_trend": f"{_S}, {_trend('shoulder_deg', True)} select session_id, n, round(first, 6) as first, round(mid, 6) as mid, round(last, 6) as last, trend from t_shoulder_deg",
    "d_tre_trend_block": f"{_S}, {_TRE} select * replace (round(consistency, 6) as consistency) from tre",
    "d_pat_pattern_block": f"{_S}, {_PAT} select * from pat",
    "d_sum_summary_block": f"{_S}, {_TRE}, {_SUM} select * from summ",
    "cj3_session_summary": f"{_S}, {_BY_TYPE}, {_TRE}, {_SUM}, {_PAT}, b as (select session_id, sum(n)::BIGINT as clean_strokes, round(avg(mean_tempo), 6) as tempo from bt group by session_id) select * from summ join pat using (session_id) join b using (session_id)",
    "flt5_keep_and_number": f"{_S}, k as (select *, case when confidence >= 0.85 then 'auto_accept' when confidence >= 0.6 then 'coach_review' else 'discard' end as a from strokes) select session_id, stroke_index, row_number() over (partition by session_id order by stroke_index)::INTEGER as kept_index, case when a = 'auto_accept' and tempo / 2.5::DOUBLE < 0.7 then 'coach_review' else a end as action from k where a <> 'discard'",
    "ux1_type_override": f"{_S} select session_id, case when stroke_index % 10 = 0 then 'SV' else stroke_type end as stroke_type, count(*) as n from strokes group by 1, 2",
    "snk2_session_documents": f"""{_S}, {_BY_TYPE}, {_TRE}, {_PAT}, top as (select * from (select *, row_number() over (partition by session_id order by {_POS.format('stroke_type')}) as k from bt) where k = 1)
select s.session_id, count(*) as n, max(case when stroke_index = 1 then s.stroke_type end) as first_type, any_value(top.stroke_type) as top_type, any_value(top.n) as top_n, any_value(dominant) as dominant, any_value(tempo_trend) as tempo_trend
from strokes s left join top using (session_id) left join tre using (session_id) left join pat using (session_id) group by s.session_id""",
    "ag5_keyframe_accuracy": f"{_ERR} select stroke_type, keyframe, count(*) as n, round(avg(ok::INT::DOUBLE), 6) as accuracy, round(avg(error_ms), 6) as mae_ms, count(*) filter (where reason = 'no prediction') as missing from err group by grouping sets ((stroke_type, keyframe), ())",
    "ag6_failures": f"{_ERR} select stroke_type, keyframe, reason, count(*) as n from err where not ok group by all",
    "ag7_agreement": f"""{duck('lab')}, r as (select *, clip_id % 4000 as task, row_number() over (partition by clip_id % 4000 order by clip_id) as k from lab),
p as (select a.impact_frame as ia, b.impact_frame as ib, a.backswing_frame as ba, b.backswing_frame as bb from r a join r b on a.task = b.task and a.k = 1 and b.k = 2)
select 'impact_frame' as column, count(*) as pairs, round(avg((abs(ia - ib) <= 20)::INT::DOUBLE), 6) as agreement from p having count(*) > 0 union all select 'backswing_frame', count(*), round(avg((abs(ba - bb) <= 20)::INT::DOUBLE), 6) from p having count(*) > 0""",
    "ag8_deviation_bins": f"{_ERR}, bins as (select * from (values (0::DOUBLE, 15::DOUBLE), (15, 30), (30, 999)) b(low, high)), x as (select e.ok, p.deviation_deg as dev from err e join prd p using (clip_id) where keyframe = 'impact') select low, high, count(x.ok) as n, round(avg(x.ok::INT::DOUBLE), 6) as accuracy from bins left join x on dev >= low and dev < high group by low, high",
    "ag9_spotting": f"""{duck('sig')}, s as (select * from sig where x is not null), t as (select clip_id, frame as a from s where frame % 9 = 0), f as (select clip_id, frame as q from s where x > 60),
h as (select t.clip_id, t.a, f.q from t join f on t.clip_id = f.clip_id and f.q between t.a and t.a + 3),
n as (select clip_id, count(*) as segments from t group by clip_id), m as (select clip_id, count(*) as predictions from f group by clip_id), g as (select clip_id, count(distinct a) as sh, count(distinct q) as ph from h group by clip_id)
select clip_id, coalesce(segments, 0) as segments, coalesce(predictions, 0) as predictions, round(case when segments > 0 then coalesce(sh, 0)::DOUBLE / segments end, 6) as recall, round(case when predictions > 0 then coalesce(ph, 0)::DOUBLE / predictions end, 6) as precision from n full join m using (clip_id) left join g using (clip_id)""",
    "ag27_classification_report": f"""{duck('lab', 'prd')}, r as (select stroke_type as a, case when deviation_deg < 30 then stroke_type when deviation_deg < 38 then 'FH' else 'BH' end as p from lab join prd using (clip_id)),
l as (select a as label, count(*) as support, count(*) filter (where a = p) as hits from r group by a), c as (select p as label, count(*) as called from r group by p)
select label, coalesce(support, 0) as support, round(case when coalesce(called, 0) > 0 then hits::DOUBLE / called end, 6) as precision, round(case when support > 0 then hits::DOUBLE / support end, 6) as recall, round(case when hits > 0 then 2::DOUBLE * hits / (called + support) else 0 end, 6) as f1 from l full join c using (label)""",
}
