"""Registered queries of sources and sinks: the tables are rendered as the files' text and read back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from ..sources import files, sinks
from ..sources.adapters import duck, view
from .series import CLIP, r6


def src1_stroke_labels(spark, d):
    lab = view(spark, d, "lab")
    text = lab.select(
        F.concat(F.lit(" clips/"), F.col("clip_id"), F.lit(".mp4 ")).alias("clip_path"), F.lower("stroke_type").alias("stroke_type"), F.when(F.col("fps") == 60, "60").otherwise("").alias("fps"),
        F.concat(F.col("impact_frame"), F.lit(".7")).alias("impact_frame"), F.when(F.col("clip_id") % 5 == 0, " ").otherwise(F.col("backswing_frame").cast("string")).alias("backswing_peak_frame"),
        F.when(F.col("clip_id") % 3 == 0, "True").when(F.col("clip_id") % 3 == 1, "no").otherwise("").alias("ready_restored"), F.when(F.col("usable"), "").otherwise("FALSE").alias("usable"), F.lit("a; ;b").alias("issues"),
    )
    n = files.normalise_stroke_labels(text)
    return n.select("clip_path", "stroke_type", "fps", "impact_frame", F.col("backswing_peak_frame").cast("double").alias("backswing_peak_frame"), F.col("ready_restored").cast("string").alias("ready_restored"), "usable", F.size("issues").alias("issues"))


def src2_predictions(spark, d):
    prd = view(spark, d, "prd")
    key = F.array(F.struct(F.lit("impact").alias("name"), F.lit(None).cast("int").alias("frame_index"), F.col("impact_ms").alias("timestamp_ms"), F.col("detected").alias("detected")))
    stroke = F.struct(F.struct(F.lit("FH").alias("stroke_type"), F.lit(30.0).alias("fps")).alias("stroke_metadata"), key.alias("keyframes"))
    body = F.to_json(F.struct(F.when(F.col("clip_id") % 10 == 0, F.array().cast("array<struct<a:int>>").cast("string")).otherwise(F.lit(None)).alias("x"), F.when(F.col("clip_id") % 10 != 0, F.array(stroke)).alias("strokes")))
    docs = prd.select(F.concat(F.lit("out/"), F.when(F.col("clip_id") % 7 == 0, "batch_summary").otherwise(F.col("clip_id").cast("string")), F.lit(".json")).alias("path"), F.when(F.col("clip_id") % 11 == 0, "{broken").otherwise(body).alias("body"))
    s = files.first_strokes(docs, "out/")
    return r6(s.select("clip", "stroke_type", F.element_at("keyframes", 1)["timestamp_ms"].alias("impact_ms")), "impact_ms")


def src3_ball_detections(spark, d):
    b = view(spark, d, "boxes").filter("class = 'ball'")
    text = b.select("clip_id", "box_key", F.col("frame").cast("string").alias("frame"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), F.when(F.col("box_key") % 4 == 0, "0.1").when(F.col("box_key") % 4 == 1, "").otherwise("0.9").alias("confidence"))
    return r6(files.normalise_ball(text, CLIP, ["box_key"]).select("clip_id", "frame", "x", "y"), "x", "y")


def src5_resume_catalogue(spark, d):
    lab = view(spark, d, "lab")
    paths = lab.select(F.concat(F.lower("stroke_type"), F.lit("/"), F.col("clip_id"), F.when(F.col("clip_id") % 9 == 0, ".txt").when(F.col("clip_id") % 2 == 0, ".MOV").otherwise(".mp4")).alias("path"))
    done = lab.filter("usable").select(F.concat(F.lower("stroke_type"), F.lit("/"), F.col("clip_id"), F.lit(".json")).alias("output"))
    return files.catalogue(paths, done)


def src6_court_clicks(spark, d):
    s = view(spark, d, "segs")
    points = F.array(F.struct(F.lit("net").alias("feature"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit("moon").alias("feature"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    docs = s.select(F.col("seg_id").alias("camera_id"), F.to_json(F.struct(F.lit(960).alias("frame_width"), F.lit(540).alias("frame_height"), points.alias("points"))).alias("body"))
    named = spark.createDataFrame([("net", 0.0, 11.885, 0.914), ("service", 0.0, 5.485, 0.0)], "feature string, world_x double, world_z double, world_y double")
    return files.explode_clicks(docs, named)


def src9_detector_classes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat(F.lit("Sports "), F.when(F.col("event_type").isin("view", "click"), "Ball").when(F.col("event_type") == "signup", "RACKET").when(F.col("event_type") == "error", "player").otherwise("dog"))
    return e.select(files.class_of(name).alias("class")).filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def src10_boxes_by_frame(spark, d):
    b = view(spark, d, "boxes").filter("class = 'racket'").groupBy("clip_id", "frame").agg(F.min("w").alias("w"), F.min("h").alias("h"))
    docs = b.groupBy("clip_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.array(F.lit(1), F.lit(2), "w", "h"))))).alias("body"))
    return files.boxes_by_frame(docs, CLIP)


def snk1_stroke_documents(spark, d):
    s = view(spark, d, "strokes").withColumn("stroke_id", F.format_string("%d_stroke-%02d", "session_id", "stroke_index"))
    keys = s.select("stroke_id", F.lit("impact").alias("name"), F.when(F.col("is_clean"), F.col("stroke_index")).alias("frame_index"), F.when(F.col("is_clean"), F.col("recovery_ms")).alias("timestamp_ms"))
    offsets = s.select("stroke_id", F.lit(100).alias("frame_offset"), F.lit(1000.0).alias("offset_ms"))
    doc = sinks.stroke_documents(s.select("stroke_id", "stroke_type", "tempo", "confidence"), keys, offsets)
    k = F.element_at("keyframes", 1)
    return doc.select("stroke_id", "stroke_type", k["frame_index"].cast("double").alias("frame"), F.floor(k["timestamp_ms"]).cast("double").alias("ms"), k["detected"].alias("detected"), F.round("metrics.tempo", 6).alias("tempo"))


def snk4_batch_summary(spark, d):
    s = view(spark, d, "strokes").select(F.col("stroke_index").cast("string").alias("path"), F.col("is_clean").alias("ok"), sessions.recommended_action(F.col("confidence")).alias("action"))
    return sinks.batch_summary(s).withColumn("by_action", F.to_json("by_action"))


def snk8_frames_for_labelling(spark, d):
    lab = view(spark, d, "prd").select("clip_id", "impact_ms", F.lit(30.0).alias("fps"), F.lit(100).alias("frame_count"))
    return sinks.frames_for_labelling(lab, 6, 3).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("sum_frame"))


QUERIES = {f.__name__: f for f in (src1_stroke_labels, src2_predictions, src3_ball_detections, src5_resume_catalogue, src6_court_clicks, src9_detector_classes, src10_boxes_by_frame, snk1_stroke_documents, snk4_batch_summary, snk8_frames_for_labelling)}

ORACLE_SQL = {
    "src1_stroke_labels": f"""{duck('lab')} select 'clips/' || clip_id || '.mp4' as clip_path, lower(stroke_type) as stroke_type, fps::DOUBLE as fps, impact_frame::INTEGER as impact_frame, case when clip_id % 5 <> 0 then backswing_frame end::DOUBLE as backswing_peak_frame,
case clip_id % 3 when 0 then 'true' when 1 then 'false' end as ready_restored, usable, 2 as issues from lab""",
    "src2_predictions": f"{duck('prd')} select clip_id::VARCHAR as clip, 'FH' as stroke_type, round(impact_ms, 6) as impact_ms from prd where clip_id % 7 <> 0 and clip_id % 10 <> 0 and clip_id % 11 <> 0",
    "src3_ball_detections": f"""{duck('boxes')}, b as (select clip_id, frame, max_by(x, box_key) as x, max_by(y, box_key) as y from boxes where class = 'ball' and box_key % 4 <> 0 group by clip_id, frame),
s as (select clip_id, unnest(generate_series(0, max(frame))) as frame from b group by clip_id) select s.clip_id, s.frame::INTEGER as frame, round(x, 6) as x, round(y, 6) as y from s left join b using (clip_id, frame)""",
    "src5_resume_catalogue": f"{duck('lab')} select lower(stroke_type) || '/' || clip_id || case when clip_id % 2 = 0 then '.MOV' else '.mp4' end as path, stroke_type, lower(stroke_type) || '/' || clip_id || '.json' as output from lab where not usable and clip_id % 9 <> 0",
    "src6_court_clicks": f'{duck("segs")} select \'net\' as feature, seg_id as camera_id, x1 as x, y1 as y, 0::DOUBLE as world_x, 11.885::DOUBLE as world_z, 0.914::DOUBLE as world_y from segs',
    "src9_detector_classes": "select case when event_type in ('view', 'click') then 'ball' when event_type = 'signup' then 'racket' else 'person' end as class, count(*) as n from events where event_type in ('view', 'click', 'signup', 'error') group by 1",
    "src10_boxes_by_frame": f"{duck('boxes')} select clip_id, frame, 1 as x, 2 as y, min(w)::INTEGER as w, min(h)::INTEGER as h from boxes where class = 'racket' group by clip_id, frame",
    "snk1_stroke_documents": f"""{duck('strokes')} select session_id || '_stroke-' || case when stroke_index < 10 then '0' else '' end || stroke_index as stroke_id, stroke_type, case when is_clean then stroke_index + 100 end::DOUBLE as frame,
floor(round(case when is_clean then recovery_ms + 1000 end, 2)) as ms, is_clean as detected, round(tempo, 6) as tempo from strokes""",
    "snk4_batch_summary": f"""{duck('strokes')}, a as (select is_clean as ok, case when confidence >= 0.85 then 'auto_accept' when confidence >= 0.6 then 'coach_review' else 'discard' end as action from strokes), b as (select action, count(*) as n from a where ok group by action)
select (select count(*) from a) as total, (select count(*) from a where ok) as ok, (select count(*) from a where not ok) as failed, '{{' || string_agg('"' || action || '":' || n, ',' order by action) || '}}' as by_action from b""",
    "snk8_frames_for_labelling": f"""{duck('prd')}, f as (select clip_id, unnest(generate_series(round(impact_ms / 1000 * 30)::INT - 6, round(impact_ms / 1000 * 30)::INT + 6, 3)) as frame from prd)
select clip_id, count(*) as n, sum(frame)::BIGINT as sum_frame from f where frame >= 0 and frame < 100 group by clip_id""",
}
