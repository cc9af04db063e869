"""Registered queries of the join operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins
from ..sources.adapters import duck, view
from .series import CLIP, r6


def _path():
    return F.concat(F.lit("clips/"), F.col("stroke_type"), F.lit("/"), F.col("clip_id").cast("string"), F.lit(".mp4"))


def jn1_label_prediction(spark, d):
    lab = view(spark, d, "lab").withColumn("path", _path())
    # every third prediction is filed elsewhere and can only match by stem; every ninth stem is there twice
    types = lab.select("clip_id", "stroke_type")
    prd = view(spark, d, "prd").join(types, "clip_id")
    own = prd.withColumn("path", F.when(F.col("clip_id") % 3 == 0, F.concat(F.lit("other/"), F.col("clip_id").cast("string"), F.lit(".json"))).otherwise(_path()))
    again = own.filter("clip_id % 9 = 0").withColumn("path", F.concat(F.lit("more/"), F.col("clip_id").cast("string"), F.lit(".json")))
    out = joins.match_path_or_stem(lab.select("path", "clip_id"), own.unionByName(again).select("path", "impact_ms"), "path", ["impact_ms"])
    return r6(out.select("clip_id", "impact_ms"), "impact_ms")


def jn2_interval_semi(spark, d):
    """Every seventh frame stands in for the start of a stroke, a table the driver does not have."""
    s = view(spark, d, "sig").filter("x is not null")
    spans = s.filter("frame % 7 = 0").select("clip_id", (F.col("frame") + 0).alias("a"), (F.col("frame") + 2).alias("b"))
    hits = joins.interval_join(s.filter("x > 60").select("clip_id", "frame"), spans, CLIP, "frame", "a", "b", 16)
    return hits.groupBy("clip_id").agg(F.countDistinct("a").alias("spans_hit"), F.countDistinct("frame").alias("points_in"))


def jn3_next_within(spark, d):
    s = view(spark, d, "sig").filter("x is not null")
    return joins.asof_forward(s.filter("x > 50").select("clip_id", "frame"), s.filter("x < 10").select("clip_id", F.col("frame").alias("bounce")), CLIP, "frame", "bounce", 4, "next_frame").withColumn("next_frame", F.col("next_frame").cast("double"))


def jn4_band_semi(spark, d):
    return _band(view(spark, d, "sig"), joins.band_semi)


def jn5_band_anti(spark, d):
    return _band(view(spark, d, "sig"), joins.band_anti)


def _band(s, how):
    return how(s.filter("x > 50").select("clip_id", "frame"), s.filter("x < 5").select("clip_id", F.col("frame").alias("f")), CLIP, "frame", "f", 2)


def jn6_cut_windows(spark, d):
    s = view(spark, d, "sig").filter("x is not null")
    spans = s.filter("x > 80").select("clip_id", (F.col("frame") - 3).alias("a"), (F.col("frame") + 3).alias("b"), F.col("frame").alias("peak"))
    cut = joins.interval_join(s.select("clip_id", "frame", "x"), spans, CLIP, "frame", "a", "b", 16)
    return r6(cut.groupBy("clip_id", "peak").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("sum_x")), "sum_x")


def jn7_nearest_wrist(spark, d):
    p = view(spark, d, "pose")
    ball = p.filter("lm_id = 0").select("clip_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    wrists = p.filter("lm_id in (15, 16)").select("clip_id", "frame", F.col("lm_id").alias("wrist"), "x", "y")
    dist = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    return r6(joins.nearest(ball, wrists, ["clip_id", "frame"], dist, ["wrist"], []), "distance")


def jn8_nearest_racket(spark, d):
    b = view(spark, d, "boxes").withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    ball = b.filter("class = 'ball'").select("clip_id", "frame", F.col("box_key").alias("ball"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    racket = b.filter("class = 'racket'").select("clip_id", "frame", F.col("box_key").alias("racket"), "cx", "cy", "w", "h")
    dist = F.sqrt((F.col("cx") - F.col("bx")) ** 2 + (F.col("cy") - F.col("by")) ** 2)
    return r6(joins.nearest(ball, racket, ["clip_id", "frame"], dist, ["racket"], ["ball"], limit=20 * F.greatest("w", "h")), "distance")


def _fragments(spark, d):
    b = view(spark, d, "crowd").withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2).withColumn("part", F.floor(F.col("frame") / 240))
    k = F.struct("frame", "box_key")
    return b.groupBy("clip_id", (F.col("track_id") * 10 + F.col("part")).alias("track_id")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.min_by("cx", k).alias("cx0"), F.min_by("cy", k).alias("cy0"), F.max_by("cx", k).alias("cx1"), F.max_by("cy", k).alias("cy1"))


def jn11_fragment_pairs(spark, d):
    return r6(joins.fragment_pairs(_fragments(spark, d), CLIP, 2.0, 540.0), "gap_s", "score")


def jn12_overlap_pairs(spark, d):
    b = view(spark, d, "crowd").select("clip_id", "track_id", "frame", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    return r6(joins.overlap_pairs(b, CLIP, 60.0, 0.05), "distance", "overlap")


def jn13_box_merge_pairs(spark, d):
    b = view(spark, d, "crowd").select("clip_id", "frame", "box_key", "x", "y", (F.col("w") * 5).alias("w"), (F.col("h") * 3).alias("h"))
    side = lambda s: b.select("clip_id", "frame", *[F.col(c).alias(f"{c}_{s}") for c in ("box_key", "x", "y", "w", "h")])
    p = side("a").join(side("b"), ["clip_id", "frame"]).filter("box_key_a < box_key_b")
    over = F.least(F.col("x_a") + F.col("w_a"), F.col("x_b") + F.col("w_b")) - F.greatest("x_a", "x_b")
    gap = F.greatest("y_a", "y_b") - F.least(F.col("y_a") + F.col("h_a"), F.col("y_b") + F.col("h_b"))
    return p.filter((over > 0) & (gap <= 0.3 * F.least("h_a", "h_b"))).select("clip_id", "frame", F.col("box_key_a").alias("a"), F.col("box_key_b").alias("b"))


def jn14_intersections(spark, d):
    from ..operators import court

    p = court.intersections(view(spark, d, "segs"), ["frame"])
    return p.select("frame", "a", "b", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


def jn15_consensus(spark, d):
    from ..operators import court

    s = view(spark, d, "segs")
    return court.consensus(court.intersections(s, ["frame"]), s, ["frame"], 5.0)


def jn18_densify(spark, d):
    b = view(spark, d, "boxes").filter("class = 'ball'").groupBy("clip_id", "frame").agg(F.max_by("x", "box_key").alias("x"))
    return r6(joins.densify(b, CLIP, "frame"), "x")


def jn19_resume(spark, d):
    lab, prd = view(spark, d, "lab"), view(spark, d, "prd")
    return lab.join(prd, "clip_id", "left_anti").select("clip_id", "stroke_type")


def jn20_annotator_pairs(spark, d):
    lab = view(spark, d, "lab").withColumn("task", F.col("clip_id") % 4000)
    return joins.first_two(lab, ["task"], ["clip_id"], ["impact_frame", "backswing_frame"])


def so3_difference(spark, d):
    s = view(spark, d, "segs")
    return s.select("frame", "seg_id").join(s.filter("y1 > y2").select("frame", "seg_id"), ["frame", "seg_id"], "left_anti")


def so5_issue_union(spark, d):
    b = view(spark, d, "boxes").groupBy("clip_id", "track_id").agg(F.max("x").alias("mx"), F.min("y").alias("my"), F.count(F.lit(1)).alias("n"))
    one = F.array_compact(F.array(F.when(F.col("mx") > 195, "far_right"), F.when(F.col("n") < 60, "short")))
    two = F.array_compact(F.array(F.when(F.col("n") < 64, "short"), F.when(F.col("my") < 3, "top")))
    return b.select("clip_id", "track_id", F.array_join(F.array_distinct(F.concat(one, two)), ";").alias("issues"))


def tk1_top_fragments(spark, d):
    n = view(spark, d, "boxes").groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"))
    w = Window.partitionBy("clip_id").orderBy(F.desc("n"), "first", "track_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")


QUERIES = {f.__name__: f for f in (jn1_label_prediction, jn2_interval_semi, jn3_next_within, jn4_band_semi, jn5_band_anti, jn6_cut_windows, jn7_nearest_wrist, jn8_nearest_racket, jn11_fragment_pairs, jn12_overlap_pairs, jn13_box_merge_pairs, jn14_intersections, jn15_consensus, jn18_densify, jn19_resume, jn20_annotator_pairs, so3_difference, so5_issue_union, tk1_top_fragments)}

_BAND = "select distinct clip_id, frame from sig a where x > 50 and {no} exists (select 1 from sig b where b.clip_id = a.clip_id and b.x < 5 and abs(a.frame - b.frame) <= 2)"
_CENTRES = "c as (select *, x + w / 2 as cx, y + h / 2 as cy from boxes)"
LINES = """
i as (select a.frame, a.seg_id as a, b.seg_id as b, a.x1, a.y1, a.x2 - a.x1 as dx, a.y2 - a.y1 as dy, b.x1 as u1, b.y1 as v1, b.x2 - b.x1 as du, b.y2 - b.y1 as dv
      from {src} a join {src} b on a.frame = b.frame and a.seg_id < b.seg_id),
p as (select frame, a, b, x1 + ((u1 - x1) * dv - (v1 - y1) * du) / (dx * dv - dy * du) * dx as x, y1 + ((u1 - x1) * dv - (v1 - y1) * du) / (dx * dv - dy * du) * dy as y from i where abs(dx * dv - dy * du) > 1e-6)"""
ORACLE_SQL = {
    "jn1_label_prediction": f"""{duck('lab', 'prd')}, l as (select *, 'clips/' || stroke_type || '/' || clip_id || '.mp4' as path from lab),
o as (select p.*, case when p.clip_id % 3 = 0 then 'other/' || p.clip_id || '.json' else l.path end as path from prd p join l using (clip_id)),
f as (select path, clip_id, impact_ms from o union all select 'more/' || clip_id || '.json', clip_id, impact_ms from o where clip_id % 9 = 0),
s as (select clip_id, count(*) as n, first(impact_ms) as impact_ms from f group by clip_id)
select l.clip_id, round(coalesce(f.impact_ms, case when s.n = 1 then s.impact_ms end), 6) as impact_ms from l left join f on l.path = f.path left join s on l.clip_id = s.clip_id""",
    "jn2_interval_semi": f"{duck('sig')} select p.clip_id, count(distinct s.frame) as spans_hit, count(distinct p.frame) as points_in from sig p join sig s on p.clip_id = s.clip_id and p.frame between s.frame and s.frame + 2 where p.x > 60 and s.frame % 7 = 0 and s.x is not null group by p.clip_id",
    "jn3_next_within": f"{duck('sig')} select a.clip_id, a.frame, min(b.frame)::DOUBLE as next_frame from sig a left join sig b on a.clip_id = b.clip_id and b.x < 10 and b.frame > a.frame and b.frame <= a.frame + 4 where a.x > 50 group by a.clip_id, a.frame",
    "jn4_band_semi": f"{duck('sig')} {_BAND.format(no='')}",
    "jn5_band_anti": f"{duck('sig')} {_BAND.format(no='not')}",
    "jn6_cut_windows": f"{duck('sig')} select s.clip_id, s.frame as peak, count(*) as rows, round(sum(p.x), 6) as sum_x from sig s join sig p on s.clip_id = p.clip_id and p.frame between s.frame - 3 and s.frame + 3 and p.x is not null where s.x > 80 group by s.clip_id, s.frame",
    "jn7_nearest_wrist": f"""{duck('pose')}, q as (select b.clip_id, b.frame, w.lm_id as wrist, sqrt((w.x - b.x) ** 2 + (w.y - b.y) ** 2) as d from pose b join pose w on b.clip_id = w.clip_id and b.frame = w.frame and w.lm_id in (15, 16) where b.lm_id = 0)
select clip_id, frame, round(d, 6) as distance, wrist from (select *, row_number() over (partition by clip_id, frame order by d, wrist) as k from q) where k = 1""",
    "jn8_nearest_racket": f"""{duck('boxes')}, {_CENTRES}, q as (select b.clip_id, b.frame, b.box_key as ball, r.box_key as racket, sqrt((r.cx - b.cx) ** 2 + (r.cy - b.cy) ** 2) as d, 20 * greatest(r.w, r.h) as most from c b join c r on b.clip_id = r.clip_id and b.frame = r.frame and r.class = 'racket' where b.class = 'ball')
select clip_id, frame, ball, round(d, 6) as distance, racket from (select *, row_number() over (partition by ball order by d, racket) as k from q where d <= most) where k = 1""",
    "jn11_fragment_pairs": f"""{duck(boxes='crowd')}, {_CENTRES}, f as (select clip_id, track_id * 10 + frame // 240 as track_id, min(frame) as first, max(frame) as last, min_by(cx, frame * 1000000 + box_key) as cx0, min_by(cy, frame * 1000000 + box_key) as cy0, max_by(cx, frame * 1000000 + box_key) as cx1, max_by(cy, frame * 1000000 + box_key) as cy1 from c group by clip_id, track_id * 10 + frame // 240),
p as (select a.clip_id, a.track_id as a, b.track_id as b, b.first - a.last as gap, sqrt((a.cx1 - b.cx0) ** 2 + (a.cy1 - b.cy0) ** 2) as dist from f a join f b on a.clip_id = b.clip_id and a.track_id <> b.track_id)
select clip_id, a, b, round(gap / 2::DOUBLE, 6) as gap_s, round(dist + gap * (378 / 120::DOUBLE), 6) as score from p where gap > 0 and gap < 120 and dist < 378""",
    "jn12_overlap_pairs": f"""{duck(boxes='crowd')}, {_CENTRES}, m as (select clip_id, track_id, count(distinct frame) as n, avg(cx) as cx, avg(cy) as cy from c group by clip_id, track_id),
f as (select distinct clip_id, track_id, frame from c), s as (select a.clip_id, a.track_id as a, b.track_id as b, count(*) as shared from f a join f b on a.clip_id = b.clip_id and a.frame = b.frame and a.track_id < b.track_id group by all),
p as (select a.clip_id, a.track_id as a, b.track_id as b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) as distance, coalesce(s.shared, 0) / least(a.n, b.n)::DOUBLE as overlap from m a join m b on a.clip_id = b.clip_id and a.track_id < b.track_id left join s on s.clip_id = a.clip_id and s.a = a.track_id and s.b = b.track_id)
select clip_id, a, b, round(distance, 6) as distance, round(overlap, 6) as overlap from p where distance < 60 and overlap <= 0.05""",
    "jn13_box_merge_pairs": f"""{duck(boxes='crowd')}, c as (select clip_id, frame, box_key, x, y, w * 5 as w, h * 3 as h from boxes)
select a.clip_id, a.frame, a.box_key as a, b.box_key as b from c a join c b on a.clip_id = b.clip_id and a.frame = b.frame and a.box_key < b.box_key
where least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0 and greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 0.3::DOUBLE * least(a.h, b.h)""",
    "jn14_intersections": f"{duck('segs')}, {LINES.format(src='segs')} select frame, a, b, round(x, 8) as x, round(y, 8) as y from p",
    "jn15_consensus": f"""{duck('segs')}, {LINES.format(src='segs')},
q as (select p.frame, p.a, p.b, abs(atan2(s.y2 - s.y1, s.x2 - s.x1) - atan2(p.y - (s.y1 + s.y2) / 2, p.x - (s.x1 + s.x2) / 2)) as t from p join segs s using (frame))
select frame, a, b, count(*) filter (where least(t - pi() * floor(t / pi()), pi() - (t - pi() * floor(t / pi()))) <= radians(5)) as inliers from q group by frame, a, b""",
    "jn18_densify": f"""{duck('boxes')}, b as (select clip_id, frame, max_by(x, box_key) as x from boxes where class = 'ball' group by clip_id, frame), s as (select clip_id, unnest(generate_series(0, max(frame))) as frame from b group by clip_id)
select s.clip_id, s.frame::INTEGER as frame, round(b.x, 6) as x from s left join b using (clip_id, frame)""",
    "jn19_resume": f"{duck('lab', 'prd')} select clip_id, stroke_type from lab where clip_id not in (select clip_id from prd)",
    "jn20_annotator_pairs": f"""{duck('lab')}, r as (select *, clip_id % 4000 as task, row_number() over (partition by clip_id % 4000 order by clip_id) as n from lab)
select a.task, a.impact_frame as impact_frame_a, b.impact_frame as impact_frame_b, a.backswing_frame as backswing_frame_a, b.backswing_frame as backswing_frame_b from r a join r b on a.task = b.task and a.n = 1 and b.n = 2""",
    "so3_difference": f"{duck('segs')} select frame, seg_id from segs except select frame, seg_id from segs where y1 > y2",
    "so5_issue_union": f"""{duck('boxes')}, b as (select clip_id, track_id, max(x) as mx, min(y) as my, count(*) as n from boxes group by clip_id, track_id)
select clip_id, track_id, concat_ws(';', case when mx > 195 then 'far_right' end, case when n < 64 then 'short' end, case when my < 3 then 'top' end) as issues from b""",
    "tk1_top_fragments": f"{duck('boxes')}, n as (select clip_id, track_id, count(*) as n, min(frame) as first from boxes group by clip_id, track_id) select * from (select *, row_number() over (partition by clip_id order by n desc, first, track_id)::INTEGER as rank from n) where rank <= 2",
}
