"""Registered queries of stroke jobs, occlusion fill, corners and the small filters and rankings, with SQL where it is told easily."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import body as B
from ..operators import court, joins, occlusion, poses, series, sessions, strokes
from ..sources.adapters import duck, view
from . import poses as P
from .series import CLIP, _points, _recursive, r6
from .tracking import _wrists, boxes


def wn8_smooth_boxes(spark, d):
    b = boxes(spark, d).groupBy("clip_id", "track_id", "frame").agg(F.avg("cx").alias("cx"))
    spine = b.groupBy("clip_id", "track_id").agg(F.min("frame").alias("a"), F.max("frame").alias("z")).select("clip_id", "track_id", F.explode(F.sequence("a", "z")).alias("frame"))
    key = ["clip_id", "track_id"]
    f = series.fill_gaps(spine.join(b, [*key, "frame"], "left"), key, ["frame"], "cx", 1 << 30, "f")
    s = series.savgol(f, key, ["frame"], "f", "s", 15)
    return r6(s.groupBy(*key).agg(F.sum("s").alias("sum_s"), F.count(F.lit(1)).alias("n")), "sum_s")


def wn14_occlusion_fill(spark, d):
    o = occlusion.fill(view(spark, d, "pose"), 0.45, least_good=5)
    return r6(o.filter("filled").select("clip_id", "lm_id", "frame", "x", "y", "z"), "x", "y", "z")


def cj3_spot_strokes(spark, d):
    e = poses.motion_energy(poses.wide(view(spark, d, "pose"))).select("clip_id", "frame", "energy")
    return r6(strokes.spot(e, 10.0, 0.8, 0.1, 0.5), "height")


def jn6_cut_strokes(spark, d):
    e = poses.motion_energy(poses.wide(view(spark, d, "pose"))).select("clip_id", "frame", "energy")
    c = strokes.cut(e, strokes.spot(e, 10.0, 0.8, 0.1, 0.5))
    return r6(c.groupBy("clip_id", "window_id").agg(F.count(F.lit(1)).alias("rows"), F.max("energy").alias("peak")), "peak")


def d_fuse_impact(spark, d):
    p = _points(spark, d).withColumn("t_ms", F.col("frame") * 1000 / F.lit(30.0))
    ball = joins.densify(p, CLIP, "frame").withColumn("t_ms", F.col("frame") * 1000 / F.lit(30.0))
    impact = ball.groupBy("clip_id").agg((F.max("t_ms") / 2).alias("impact_ms"))
    return r6(strokes.fuse_impact(impact, ball).withColumn("frame", F.col("frame").cast("double")), "impact_ms")


def wn44_event_keyframes(spark, d):
    """Every fortieth frame stands in for an impact, a table the driver does not have; the wrist is seen in some frames only."""
    w = joins.densify(_wrists(spark, d).select("clip_id", "frame", "x", "y"), CLIP, "frame")
    events = w.filter("frame % 40 = 0").select("clip_id", F.col("frame").alias("event_id"), "frame")
    k = strokes.event_keyframes(events, w, 30.0, 30.0)
    return k.withColumns({c: F.col(c).cast("double") for c in ("unit_turn", "backswing_peak", "follow_through_peak", "recovery_position")})


def wn43_path_payload(spark, d):
    """Every fiftieth frame stands in for the start of a stroke, a table the driver does not have."""
    spans = _points(spark, d).filter("frame % 50 = 0").select("clip_id", F.col("frame").alias("span_id"), F.col("frame").alias("start"), (F.col("frame") + 10).alias("end"))
    p = strokes.path_payload(_points(spark, d), spans)
    return p.select("clip_id", "span_id", F.size("path").cast("long").alias("n"), F.element_at("path", 1)["frame"].alias("first"), F.element_at("path", -1)["frame"].alias("last"))


def cj4_players(spark, d):
    b = boxes(spark, d).groupBy("clip_id", "track_id", "frame").agg(F.min_by("cx", "box_key").alias("cx"), F.min_by("cy", "box_key").alias("cy"), F.min_by("h", "box_key").alias("h"))
    c = b.select("clip_id", "track_id").distinct().withColumn("cluster", F.col("track_id") % 3).withColumn("position", F.col("track_id"))
    return r6(strokes.players(b, c).groupBy("clip_id", "cluster", "role").agg(F.count(F.lit(1)).alias("frames"), F.sum("cx").alias("sum_x")), "sum_x")


def _light(spark, d):
    """Every twentieth frame of the landmark view stands in for a hit, the clip's one player is near in even clips."""
    pose = view(spark, d, "pose")
    hits = pose.filter("lm_id = 0 and frame % 20 = 0 and frame > 0").select("clip_id", F.lit(1).alias("track_id"), "frame", F.lit("HIGH").alias("confidence"))
    players = pose.select("clip_id", F.lit(1).alias("track_id"), F.when(F.col("clip_id") % 2 == 0, "near").otherwise("far").alias("role")).distinct()
    return strokes.light_strokes(hits, players, pose, 30.0)


def d_light_strokes(spark, d):
    s = _light(spark, d)
    return r6(s.select("clip_id", "stroke_index", "frame", "role", "stroke_type", "shoulder_impact_deg", "separation_deg", "contact_height_cm", "shoulder_turn_deg"), "shoulder_impact_deg", "separation_deg", "contact_height_cm", "shoulder_turn_deg")


def cj10_light_documents(spark, d):
    doc = strokes.light_documents(_light(spark, d))
    kinds = F.transform("aggregated_metric", lambda a: F.concat_ws(":", a["stroke_type"], a["stroke_count"].cast("string")))
    return doc.select("clip_id", F.size("strokes").cast("long").alias("n"), "near", "far", F.array_join(kinds, ";").alias("kinds"), F.element_at("aggregated_metric", 1)["shoulder_rotation_mean_deg"].alias("first_rotation"))


def clu7_corners(spark, d):
    return r6(court.corners(view(spark, d, "segs"), ["frame"], 9600.0, 5400.0), "x", "y")


def clu12_project_lines(spark, d):
    lines = spark.createDataFrame([("base", -4.115, 0.0, 0.0, 4.115, 0.0, 0.0), ("net", -4.115, 0.914, 11.885, 4.115, 0.914, 11.885)], "line string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    p = court.project_lines(view(spark, d, "poses"), lines, 480.0, 270.0)
    return r6(p.select("cand_id", "line", "u1", "v1", "u2"), "u1", "v1", "u2")


def ag24_tracked_share(spark, d):
    return r6(joins.densify(_points(spark, d), CLIP, "frame").groupBy("clip_id").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("tracked")), "tracked")


def ag28_dropout(spark, d):
    p = view(spark, d, "pose").filter("lm_id in (15, 16)").groupBy("clip_id", "frame").agg(F.avg("vis").alias("v"))
    return r6(p.groupBy("clip_id").agg(F.avg((F.col("v") > 0.3).cast("double")).alias("coverage"), F.avg(F.when(F.col("v") > 0.3, F.col("v"))).alias("mean_visible"), F.avg((F.col("v") < 0.3).cast("double")).alias("dropout")), "coverage", "mean_visible", "dropout")


def prj5_actions(spark, d):
    s = view(spark, d, "strokes")
    return s.groupBy("session_id", sessions.recommended_action(F.col("confidence")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def sc6_margin_confidence(spark, d):
    return view(spark, d, "sig").select("clip_id", "frame", F.round(B.confidence_from_margin(F.col("x") - 50, 40.0), 9).alias("c"))


def sc4_union_boxes(spark, d):
    b = boxes(spark, d, "crowd")
    side = lambda s: b.select("clip_id", "frame", *[F.col(c).alias(f"{c}_{s}") for c in ("box_key", "x", "y", "w", "h")])
    x, y, w, h = B.union_box(*[F.col(f"{c}_a") for c in "xywh"], *[F.col(f"{c}_b") for c in "xywh"])
    return r6(side("a").join(side("b"), ["clip_id", "frame"]).filter("box_key_a < box_key_b").select("box_key_a", "box_key_b", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")), "x", "y", "w", "h")


def wn41_slice_gradient(spark, d):
    """Gradients taken inside the slice: the filter comes before the window, so the slice's ends are one-sided."""
    p = view(spark, d, "pose").filter("lm_id = 12").withColumn("s", F.col("t_ms") / 1000).filter("frame between 10 and 20")
    g = series.gradient(p, CLIP, ["frame"], "z", "s", "v").withColumn("v", F.abs("v"))
    return r6(g.groupBy("clip_id").agg(F.max("v").alias("peak"), F.max_by("t_ms", F.struct("v", -F.col("frame"))).alias("at_ms")), "peak", "at_ms")


def tk4_highlights(spark, d):
    s = view(spark, d, "strokes")
    w = Window.partitionBy("session_id", "stroke_type").orderBy(F.desc("confidence"), "stroke_index")
    return r6(s.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("session_id", "stroke_type", "rank", "stroke_index", "confidence"), "confidence")


QUERIES = {f.__name__: f for f in (wn8_smooth_boxes, wn14_occlusion_fill, cj3_spot_strokes, jn6_cut_strokes, d_fuse_impact, wn44_event_keyframes, wn43_path_payload, cj4_players, d_light_strokes, cj10_light_documents, clu7_corners, clu12_project_lines, ag24_tracked_share, ag28_dropout, prj5_actions, sc6_margin_confidence, sc4_union_boxes, wn41_slice_gradient, tk4_highlights)}

_C = f"{duck('boxes')}, c as (select *, x + w / 2 as cx, y + h / 2 as cy from boxes)"
_P = "p as (select clip_id, frame, min_by(x, box_key) as x, min_by(y, box_key) as y from boxes where class = 'ball' group by clip_id, frame)"
_AXES = "xyz"


def _each(text: str, by: str = ", ") -> str:
    return by.join(text.replace("@", a) for a in _AXES)


# the spline's tridiagonal system by lag and lead, eliminated forward and substituted backward as recursive queries
_SPLINE = f"""
c as (select k.clip_id, k.lm_id, k.frame, row_number() over (partition by k.clip_id, k.lm_id order by k.frame)::DOUBLE as pos, k.vis >= 0.45 as good, p.vis as pv, {_each("k.@, p.@ as p@")},
    sqrt({_each("(k.@ - p.@) ** 2", " + ")}) as len from pose k join pose p on p.clip_id = k.clip_id and p.frame = k.frame and p.lm_id = case k.lm_id when 15 then 13 when 16 then 14 when 27 then 25 else 26 end
    where k.lm_id in (15, 16, 27, 28)),
g0 as (select *, {_each("(@ - p@) / case when len = 0 then 1 else len end as u@")} from c where good),
g1 as (select *, row_number() over w as i, count(*) over (partition by clip_id, lm_id) as n, pos - lag(pos) over w as h0, lead(pos) over w - pos as h1, {_each("u@ - lag(u@) over w as d0@, lead(u@) over w - u@ as d1@")} from g0 window w as (partition by clip_id, lm_id order by pos)),
g2 as (select *, {_each("d0@ / h0 as m0@, d1@ / h1 as m1@")}, lead(h1) over w as hn, lag(h0) over w as hp, {_each("lead(d1@ / h1) over w as mn@, lag(d0@ / h0) over w as mp@")} from g1 where n >= 4 window w as (partition by clip_id, lm_id order by pos)),
sys as (select clip_id, lm_id, pos, i, n, case when i = 1 then 0 when i = n then hp + h0 else h1 end as lo, case when i = 1 then hn when i = n then hp else 2 * (h0 + h1) end as own, case when i = 1 then h1 + hn when i = n then 0 else h0 end as up,
    {_each("case when i = 1 then ((h1 + 2 * (h1 + hn)) * hn * m1@ + h1 * h1 * mn@) / (h1 + hn) when i = n then (h0 * h0 * mp@ + (2 * (hp + h0) + h0) * hp * m0@) / (hp + h0) else 3 * (h1 * m0@ + h0 * m1@) end as r@")} from g2),
fwd as (select clip_id, lm_id, pos, i, n, up / own as f, {_each("r@ / own as r@")} from sys where i = 1
    union all select s.clip_id, s.lm_id, s.pos, s.i, s.n, s.up / (s.own - s.lo * f.f), {_each("(s.r@ - s.lo * f.r@) / (s.own - s.lo * f.f)")} from fwd f join sys s on s.clip_id = f.clip_id and s.lm_id = f.lm_id and s.i = f.i + 1),
bwd as (select clip_id, lm_id, pos, i, {_each("r@ as s@")} from fwd where i = n
    union all select f.clip_id, f.lm_id, f.pos, f.i, {_each("f.r@ - f.f * b.s@")} from bwd b join fwd f on f.clip_id = b.clip_id and f.lm_id = b.lm_id and f.i = b.i - 1),
st as (select clip_id, lm_id, median(len) as limb, count(*) as n, max(pos) as last, max(greatest({_each("abs(@)")})) as most from g0 group by all),
past as (select clip_id, lm_id, {", ".join(f"sum(dz ** {p}) as q{p}" for p in range(5))}, {", ".join(f"sum(dz ** {p} * {a}) as {a}{p}" for a in _AXES for p in range(3))} from
    (select g0.*, g0.pos - st.last as dz, row_number() over (partition by clip_id, lm_id order by pos desc) as k from g0 join st using (clip_id, lm_id)) where k <= 15 group by all),
e as (select c.*, st.limb, st.n, st.last, st.most, max(c.pos) over (partition by clip_id, lm_id) as total, max(case when good then pos end) over (partition by clip_id, lm_id order by pos) as a, min(case when good then pos end) over (partition by clip_id, lm_id order by pos desc) as b from c left join st using (clip_id, lm_id)),
o as (select *, coalesce(b, total + 1) - coalesce(a, 0) - 1 as run, count(*) filter (not good and pv < 0.45) over (partition by clip_id, lm_id, coalesce(a, 0)) as hidden from e),
q as (select o.*, (o.pos - o.a) / (o.b - o.a) as t, o.b - o.a as w, {_each("ga.@ as na@, gb.@ as nb@, ga.u@ as ua@, gb.u@ as ub@, sa.s@ as sa@, sb.s@ as sb@")} from o
    left join g0 ga on ga.clip_id = o.clip_id and ga.lm_id = o.lm_id and ga.pos = o.a left join g0 gb on gb.clip_id = o.clip_id and gb.lm_id = o.lm_id and gb.pos = o.b
    left join bwd sa on sa.clip_id = o.clip_id and sa.lm_id = o.lm_id and sa.pos = o.a left join bwd sb on sb.clip_id = o.clip_id and sb.lm_id = o.lm_id and sb.pos = o.b
    where not o.good and o.a is not null and o.run <= 20 and o.n >= 5 and (o.b is null or o.hidden = 0)),
h as (select *, {_each("(1 + 2 * t) * (1 - t) ** 2 * ua@ + t * (1 - t) ** 2 * w * sa@ + t ** 2 * (3 - 2 * t) * ub@ + t ** 2 * (t - 1) * w * sb@ as v@")} from q),
k as (select *, sqrt({_each("v@ ** 2", " + ")}) as v, pos - last as dz from h),
par as (select *, q4 * (q2 * q0 - q1 * q1) - q3 * (q3 * q0 - q1 * q2) + q2 * (q3 * q1 - q2 * q2) as det from past),
ends as (select k.*, {_each("((@2 * (q2 * q0 - q1 * q1) - q3 * (@1 * q0 - q1 * @0) + q2 * (@1 * q1 - q2 * @0)) * dz * dz + (q4 * (@1 * q0 - @0 * q1) - @2 * (q3 * q0 - q1 * q2) + q2 * (q3 * @0 - @1 * q2)) * dz + q4 * (q2 * @0 - q1 * @1) - q3 * (q3 * @0 - @1 * q2) + @2 * (q3 * q1 - q2 * q2)) / det as f@")} from k join par using (clip_id, lm_id))
select clip_id, lm_id, frame, {_each("round(case when b is null then case when most <= 2 then greatest(-0.1, least(1.1, f@)) else f@ end else 0.5 * (na@ + (nb@ - na@) * t) + 0.5 * (p@ + limb * v@ / case when v = 0 then 1 else v end) end, 6) as @")} from ends"""
# hits, their keyframes by the wrist's path, and the light rules at these
_LIGHT = f"""{P._BASE}, path as (select clip_id, i, x16 as x, y16 as y from wide), hit as (select clip_id, i as f, row_number() over (partition by clip_id order by i)::INTEGER as stroke_index, x16 as ix from wide where i % 20 = 0 and i > 0),
lb as (select h.clip_id, h.f, max_by(p.i, abs(p.x - ix) * 1000000 - p.i / 1000000) as bp from hit h join path p on p.clip_id = h.clip_id and p.i between h.f - 45 and h.f - 1 group by all),
lk as (select hit.*, bp, case when bp > greatest(0, bp - 30) then (greatest(0, bp - 30) + bp) // 2 end as ut from hit left join lb using (clip_id, f)),
lf as (select *, degrees(atan2(y12 - y11, x12 - x11)) as sturn, degrees(atan2(y24 - y23, x24 - x23)) as hturn, case when v27 > 0.3 and v28 > 0.3 then (y27 + y28) / 2 when v27 > 0.3 then y27 when v28 > 0.3 then y28 end as ground from wide),
ls as (select k.clip_id, k.stroke_index, k.f::INTEGER as frame, case when k.clip_id % 2 = 0 then 'near' else 'far' end as role, case when least(a.v0, a.v11, a.v12, a.v16) < 0.3 then 'FH' when a.y16 < a.y0 - 0.05 then 'SV' when a.x16 > (a.x11 + a.x12) / 2 then 'FH' else 'BH' end as stroke_type,
  a.sturn as shoulder_impact_deg, a.sturn - a.hturn as separation_deg, case when a.v16 > 0.3 and a.v0 >= 0.3 and abs(a.ground - a.y0) >= 1e-6 then abs(a.ground - a.y16) * (170 / abs(a.ground - a.y0)) end as contact_height_cm, u.sturn as shoulder_turn_deg
  from lk k join lf a on a.clip_id = k.clip_id and a.i = k.f left join lf u on u.clip_id = k.clip_id and u.i = k.ut)"""
ORACLE_SQL = {
    "d_fuse_impact": f"""{duck('boxes')}, {_P}, s as (select clip_id, unnest(generate_series(0, max(frame))) as frame from p group by clip_id),
q as (select s.clip_id, s.frame, s.frame * 1000 / 30::DOUBLE as t, x, y from s left join p using (clip_id, frame)), im as (select clip_id, max(t) / 2 as ti from q group by clip_id),
n as (select q.*, ti, count(*) over v as n, count(x) over v as seen, min(case when x is not null then frame end) over v as lo, max(case when x is not null then frame end) over v as hi from q join im using (clip_id) where abs(t - ti) <= 150 window v as (partition by clip_id)),
g as (select *, coalesce(x, 0) as x0, coalesce(y, 0) as y0 from n where frame between lo and hi),
v1 as (select *, {", ".join(f"(coalesce(lead({c}0) over k, {c}0) - coalesce(lag({c}0) over k, {c}0)) / ((coalesce(lead(t) over k, t) - coalesce(lag(t) over k, t)) / 1000) as v{c}" for c in "xy")} from g window k as (partition by clip_id order by frame)),
v2 as (select *, sqrt({" + ".join(f"((coalesce(lead(v{c}) over k, v{c}) - coalesce(lag(v{c}) over k, v{c})) / ((coalesce(lead(t) over k, t) - coalesce(lag(t) over k, t)) / 1000)) ** 2" for c in "xy")}) as acc from v1 window k as (partition by clip_id order by frame)),
v3 as (select *, lag(acc) over k as a0, lead(acc) over k as a2, lead(t) over k as tb, row_number() over (partition by clip_id order by acc desc, frame) as r from v2 where not isnan(acc) window k as (partition by clip_id order by frame)),
f as (select clip_id, frame, coalesce(case when abs(a0 - 2 * acc + a2) >= 1e-12 then t + greatest(-0.5, least(0.5, 0.5 * (a0 - a2) / (a0 - 2 * acc + a2))) * (tb - t) end, t) as fine from v3 where r = 1 and seen >= greatest(4, floor(0.3 * n)))
select im.clip_id, round(coalesce(fine, ti), 6) as impact_ms, f.frame::DOUBLE as frame, f.clip_id is not null as fused from im left join f using (clip_id)""",
    "wn14_occlusion_fill": _recursive(f"{duck('pose')}, {_SPLINE}"),
    "wn43_path_payload": f"{duck('boxes')}, {_P} select s.clip_id, s.frame as span_id, count(*) as n, min(q.frame) as first, max(q.frame) as last from p s join p q on s.clip_id = q.clip_id and q.frame between s.frame and s.frame + 10 where s.frame % 50 = 0 and q.x is not null group by s.clip_id, s.frame",
    "cj4_players": f"""{_C}, b as (select clip_id, track_id, frame, min_by(cx, box_key) as cx, min_by(h, box_key) as h from c group by all),
l as (select clip_id, track_id % 3 as cluster, frame, max_by(cx, track_id) as cx, max_by(h, track_id) as h from b group by all),
r as (select clip_id, cluster, row_number() over (partition by clip_id order by median(h) desc, cluster) as k from l group by clip_id, cluster)
select clip_id, cluster, case k when 1 then 'near' when 2 then 'far' else 'other' end as role, count(*) as frames, round(sum(cx), 6) as sum_x from l join r using (clip_id, cluster) group by all""",
    "d_light_strokes": f"{_LIGHT} select clip_id, stroke_index, frame, role, stroke_type, round(shoulder_impact_deg, 6) as shoulder_impact_deg, round(separation_deg, 6) as separation_deg, round(contact_height_cm, 6) as contact_height_cm, round(shoulder_turn_deg, 6) as shoulder_turn_deg from ls",
    "cj10_light_documents": f"""{_LIGHT}, g as (select clip_id, stroke_type, count(*) as n, round(avg(shoulder_impact_deg), 1) as mean from ls group by all)
select ls.clip_id, count(*) as n, count(*) filter (role = 'near') as near, count(*) filter (role = 'far') as far, any_value(kinds) as kinds, any_value(first) as first_rotation from ls join
(select clip_id, string_agg(stroke_type || ':' || n, ';' order by stroke_type) as kinds, min_by(mean, stroke_type) as first from g group by clip_id) k using (clip_id) group by ls.clip_id""",
    "wn44_event_keyframes": f"""{_C}, w0 as (select clip_id, frame, min_by(cx, box_key) as x, min_by(cy, box_key) as y from c where class = 'person' group by all),
w1 as (select s.clip_id, s.frame, x, y from (select clip_id, unnest(generate_series(0, max(frame))) as frame from w0 group by clip_id) s left join w0 using (clip_id, frame)),
w as (select *, sqrt((lead(x) over v - x) ** 2 + (lead(y) over v - y) ** 2) as step, max(frame) over (partition by clip_id) + 1 as total from w1 window v as (partition by clip_id order by frame)),
ev as (select clip_id, frame as f, coalesce(x, 0) as ix, total from w where frame % 40 = 0),
b as (select e.clip_id, e.f, max_by(w.frame, abs(w.x - ix) * 1000000 - w.frame / 1000000) as bp from ev e join w on w.clip_id = e.clip_id and w.frame between e.f - 45 and e.f - 1 and w.x is not null group by all),
t as (select e.clip_id, e.f, min_by(w.frame, w.y * 1000000 + w.frame / 1000000) as ft from ev e join w on w.clip_id = e.clip_id and w.frame between e.f and e.f + 29 and w.y is not null group by all),
r as (select t.clip_id, t.f, min(w.frame) as still from t join w on w.clip_id = t.clip_id and w.frame >= ft and w.frame < least(w.total, ft + 75) - 1 and w.step < 30 group by all)
select e.clip_id, e.f::INTEGER as event_id, (case when bp > greatest(0, bp - 30) then (greatest(0, bp - 30) + bp) // 2 end)::DOUBLE as unit_turn, bp::DOUBLE as backswing_peak, e.f::INTEGER as impact, ft::DOUBLE as follow_through_peak, coalesce(still, least(total, ft + 75) - 1)::DOUBLE as recovery_position
from ev e left join b using (clip_id, f) left join t using (clip_id, f) left join r using (clip_id, f)""",
    "clu12_project_lines": f"""{duck('poses')}, l as (select * from (values ('base', 0::DOUBLE, 0::DOUBLE), ('net', 0.914, 11.885)) l(line, y, z)),
g as (select cand_id, line, focal_px, radians(pan_deg) as p, radians(tilt_deg) as t, y - height_m as dy, z + distance_m as dz from poses, l),
q as (select *, -4.115::DOUBLE * cos(p) - dz * sin(p) as rx1, -4.115::DOUBLE * sin(p) + dz * cos(p) as rz1, 4.115::DOUBLE * cos(p) - dz * sin(p) as rx2, 4.115::DOUBLE * sin(p) + dz * cos(p) as rz2 from g),
r as (select *, rz1 * cos(t) - dy * sin(t) as d1, rz2 * cos(t) - dy * sin(t) as d2, dy * cos(t) + rz1 * sin(t) as ry1 from q)
select cand_id, line, round(case when d1 > 0.05 and d2 > 0.05 then 480 + focal_px * rx1 / d1 end, 6) as u1, round(case when d1 > 0.05 and d2 > 0.05 then 270 - focal_px * ry1 / d1 end, 6) as v1, round(case when d1 > 0.05 and d2 > 0.05 then 480 + focal_px * rx2 / d2 end, 6) as u2 from r""",
    "ag24_tracked_share": f"{duck('boxes')}, {_P} select clip_id, round(count(x)::DOUBLE / (max(frame) + 1), 6) as tracked from p group by clip_id",
    "ag28_dropout": f"{duck('pose')}, q as (select clip_id, frame, avg(vis) as v from pose where lm_id in (15, 16) group by all) select clip_id, round(avg((v > 0.3)::INT::DOUBLE), 6) as coverage, round(avg(v) filter (where v > 0.3), 6) as mean_visible, round(avg((v < 0.3)::INT::DOUBLE), 6) as dropout from q group by clip_id",
    "prj5_actions": f"{duck('strokes')} select session_id, case when confidence >= 0.85 then 'auto_accept' when confidence >= 0.6 then 'coach_review' else 'discard' end as action, count(*) as n from strokes group by all",
    "sc6_margin_confidence": f"{duck('sig')} select clip_id, frame, round(case when x is not null then greatest(0.5::DOUBLE, least(0.95::DOUBLE, 0.5 + abs(x - 50) / 40 * 0.45::DOUBLE)) else 0.95 end, 9) as c from sig",
    "sc4_union_boxes": f"{duck(boxes='crowd')} select a.box_key as box_key_a, b.box_key as box_key_b, round(least(a.x, b.x), 6) as x, round(least(a.y, b.y), 6) as y, round(greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x), 6) as w, round(greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y), 6) as h from boxes a join boxes b on a.clip_id = b.clip_id and a.frame = b.frame and a.box_key < b.box_key",
    "wn41_slice_gradient": f"""{duck('pose')}, g as (select *, abs((coalesce(lead(z) over w, z) - coalesce(lag(z) over w, z)) / (coalesce(lead(t_ms) over w, t_ms) - coalesce(lag(t_ms) over w, t_ms)) * 1000) as v from pose where lm_id = 12 and frame between 10 and 20 window w as (partition by clip_id order by frame))
select clip_id, round(v, 6) as peak, round(t_ms, 6) as at_ms from (select *, row_number() over (partition by clip_id order by v desc, frame) as k from g) where k = 1""",
    "tk4_highlights": f"{duck('strokes')} select session_id, stroke_type, rank::INTEGER as rank, stroke_index, round(confidence, 6) as confidence from (select *, row_number() over (partition by session_id, stroke_type order by confidence desc, stroke_index) as rank from strokes) where rank <= 2",
}
