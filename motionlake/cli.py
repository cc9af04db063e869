"""Command-line jobs for spark-submit: tables in, tables out.

    spark-submit -m motionlake.cli strokes  --pose POSE_PARQUET --out DIR
    spark-submit -m motionlake.cli recordings --pose POSE_PARQUET --out DIR   (spotted strokes and session documents)
    spark-submit -m motionlake.cli players  --boxes BOXES_PARQUET --out DIR
    spark-submit -m motionlake.cli dropout  --pose POSE_PARQUET --out DIR
    spark-submit -m motionlake.cli impact-frames --labels PARQUET --out DIR
    spark-submit -m motionlake.cli camera-poses --clicks PARQUET --out DIR
    spark-submit -m motionlake.cli hit-gate --candidates CSV --out MODEL_DIR
    spark-submit -m motionlake.cli session  --strokes STROKES_PARQUET --out DIR
    spark-submit -m motionlake.cli evaluate --labels CSV --predictions JSON_DIR --out DIR
    spark-submit -m motionlake.cli batch    --root VIDEO_DIR --done OUTPUTS_PARQUET --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ml_gate
from .operators import court_jobs, evaluation, jobs, joins, poses, records, sessions, tracks
from .sources import files, sinks


def run(spark: SparkSession, argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="motionlake")
    sub = p.add_subparsers(dest="job", required=True)
    for job, names in {
        "strokes": ["pose"], "recordings": ["pose"], "players": ["boxes"], "dropout": ["pose"], "impact-frames": ["labels"], "camera-poses": ["clicks"], "hit-gate": ["candidates"], "session": ["strokes"], "evaluate": ["labels", "predictions"], "batch": ["root", "done"],
    }.items():
        s = sub.add_parser(job)
        for n in [*names, "out"]:
            s.add_argument(f"--{n}", required=n != "done")
        s.add_argument("--width", type=float, default=960.0, help="picture width in pixels")
        s.add_argument("--height", type=float, default=540.0, help="picture height in pixels")
        s.add_argument("--fps", type=float, default=30.0)
    a = p.parse_args(argv)
    if a.job == "strokes":
        jobs.stroke_job(files.read_pose(spark, a.pose), source_fps=a.fps).write.mode("overwrite").parquet(a.out)
    elif a.job == "recordings":
        sinks.write_documents(jobs.session_job(files.read_pose(spark, a.pose), a.fps), a.out)
    elif a.job == "players":
        tracks.players_from_boxes(spark.read.parquet(a.boxes), a.width, a.height).write.mode("overwrite").parquet(a.out)
    elif a.job == "dropout":
        records.diagnostics(poses.wide(files.read_pose(spark, a.pose))).write.mode("overwrite").parquet(a.out)
    elif a.job == "impact-frames":
        sinks.write_csv(sinks.frames_for_labelling(spark.read.parquet(a.labels), 5, 1), a.out)
    elif a.job == "camera-poses":
        found = court_jobs.search_poses(spark.read.parquet(a.clicks), ["camera_id"], a.width / 2, a.height / 2, rounds=6, zoom=0.4)
        sinks.write_camera_poses(found, a.out, int(a.width), int(a.height))
    elif a.job == "hit-gate":
        ml_gate.train(files.read_hit_candidates(spark, a.candidates)).write().overwrite().save(a.out)
    elif a.job == "session":
        sinks.write_documents(sessions.documents(spark.read.parquet(a.strokes)), a.out)
    elif a.job == "evaluate":
        labels = files.read_stroke_labels(spark, a.labels).withColumn("clip_id", F.regexp_replace("clip_path", r"\.[^./]+$", ""))
        found = files.read_predictions(spark, a.predictions).select(F.col("clip").alias("clip_id"), "keyframes")
        matched = joins.match_path_or_stem(labels.select("clip_id"), found, "clip_id", ["keyframes"])
        keys = matched.select("clip_id", F.explode("keyframes").alias("k")).select("clip_id", F.col("k.name").alias("keyframe"), F.col("k.detected").alias("detected"), F.col("k.timestamp_ms").alias("timestamp_ms"))
        errors = evaluation.keyframe_errors(labels.select("clip_id", "stroke_type", "fps", "usable", *files.FRAME_COLUMNS[:4]), keys, 1)
        report = evaluation.keyframe_accuracy(errors)
        report.write.mode("overwrite").parquet(f"{a.out}/accuracy")
        sinks.report_lines(report).orderBy("stroke_type", "keyframe").select("line").write.mode("overwrite").text(f"{a.out}/report")
        errors.filter("not ok").write.mode("overwrite").parquet(f"{a.out}/failures")
    else:
        done = spark.read.parquet(a.done) if a.done else None
        files.catalogue(files.read_catalogue(spark, a.root), done).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("motionlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(session, sys.argv[1:])
