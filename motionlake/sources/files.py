"""Readers for label, prediction, detection and court files, always with an explicit schema. Text columns are cleaned by
the ``normalise_*`` functions, which also take tables that hold the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the label files.
STROKE_LABEL_COLUMNS = "clip_path stroke_type dominant_side fps label_tier unit_turn_frame backswing_peak_frame impact_frame follow_through_peak_frame ready_restored ready_frame impact_ambiguous usable issues annotator_id notes".split()
SESSION_LABEL_COLUMNS = "session_path segment_index stroke_type start_time_s end_time_s impact_time_s annotator_id notes".split()
FRAME_COLUMNS = "unit_turn_frame backswing_peak_frame impact_frame follow_through_peak_frame ready_frame".split()
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "m4v")
BOM = "﻿"
PREDICTION_SCHEMA = "session_metadata struct<session_id:string>, strokes array<struct<stroke_metadata:struct<stroke_type:string,fps:double>,keyframes:array<struct<name:string,frame_index:int,timestamp_ms:double,detected:boolean>>>>"
CLICKS_SCHEMA = "frame_width int, frame_height int, points array<struct<feature:string,x:double,y:double>>"


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def trimmed(df: DataFrame) -> DataFrame:
    """All text columns without surrounding space or byte-order mark; empty text is NULL."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, BOM, "")), F.lit(""))
    return df.select(*[clean(F.col(f.name)).alias(f.name.replace(BOM, "").strip()) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def number(text: Column) -> Column:
    """Text to a whole number by way of a double, cut towards zero; NULL where it is no number."""
    return text.try_cast("double").try_cast("int")


def tri_state(text: Column) -> Column:
    """true, false or NULL for anything else."""
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def normalise_stroke_labels(df: DataFrame) -> DataFrame:
    """Types of a stroke-label table of text: fps 30 by default, usable unless it says false, frames nullable whole numbers."""
    t = trimmed(df)
    out = t.withColumn("fps", F.coalesce(F.col("fps").try_cast("double"), F.lit(30.0))).withColumn("usable", F.coalesce(F.lower("usable"), F.lit("true")) != "false")
    for c in FRAME_COLUMNS:
        if c in t.columns:
            out = out.withColumn(c, number(F.col(c)))
    for c in ("ready_restored", "impact_ambiguous"):
        if c in t.columns:
            out = out.withColumn(c, tri_state(F.col(c)))
    return out.withColumn("issues", F.filter(F.transform(F.split(F.coalesce("issues", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")) if "issues" in t.columns else out


def read_stroke_labels(spark: SparkSession, path: str) -> DataFrame:
    return normalise_stroke_labels(spark.read.schema(_text_schema(STROKE_LABEL_COLUMNS)).option("header", True).option("enforceSchema", True).csv(path))


def normalise_session_labels(df: DataFrame) -> DataFrame:
    t = trimmed(df)
    return t.withColumn("segment_index", number(F.col("segment_index"))).withColumns({c: F.col(c).try_cast("double") for c in ("start_time_s", "end_time_s", "impact_time_s")})


def read_session_labels(spark: SparkSession, path: str) -> DataFrame:
    return normalise_session_labels(spark.read.schema(_text_schema(SESSION_LABEL_COLUMNS)).option("header", True).csv(path))


def first_strokes(docs: DataFrame, root: str = "") -> DataFrame:
    """Prediction documents (``path``, ``body`` JSON text) to one row each: key without root and suffix, first stroke's type
    and its keyframes. Batch summaries and documents without a stroke or that do not parse are left out."""
    rows = docs.filter(~F.col("path").rlike(r"(^|/)batch_summary\.json$")).withColumn("d", F.from_json("body", PREDICTION_SCHEMA))
    rows = rows.filter(F.size("d.strokes") > 0).withColumn("s", F.element_at("d.strokes", 1))
    key = F.regexp_replace(F.regexp_replace("path", "^" + root, ""), r"\.json$", "")
    return rows.select(key.alias("clip"), F.col("s.stroke_metadata.stroke_type").alias("stroke_type"), F.col("s.keyframes").alias("keyframes"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return first_strokes(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")), r".*?" + path.rstrip("/").replace(".", r"\.") + "/")


def normalise_ball(df: DataFrame, keys: list[str], order: list[str], floor: float = 0.3) -> DataFrame:
    """Detections ``frame, x, y, confidence`` (text or numbers; confidence 1 by default) above the floor, one per frame (the
    last in ``order``), on a dense frame axis from 0."""
    from ..operators.joins import densify

    t = df.select(*keys, *[o for o in order if o not in keys], F.col("frame").try_cast("double").cast("int").alias("frame"), F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"))
    last = F.max_by(F.struct("x", "y", "confidence"), F.struct(*order)).alias("p")
    one = t.filter((F.col("confidence") >= floor) & F.col("frame").isNotNull()).groupBy(*keys, "frame").agg(last).select(*keys, "frame", "p.*")
    return densify(one, keys, "frame")


def read_ball_csv(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(_text_schema(["frame", "x", "y", "confidence"])).option("header", True).csv(path)
    return normalise_ball(t.select("*", F.col("_metadata.file_path").alias("clip_id"), F.monotonically_increasing_id().alias("row")), ["clip_id"], ["row"])


def catalogue(paths: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Jobs of a data set: video files below a stroke-type folder, with the output path of each; those in ``done``
    (``output``) are left out, so a run resumes where the last one stopped. ``paths``: ``path`` relative to the root."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    jobs = paths.filter(suffix.isin(*VIDEO_SUFFIXES) & F.contains(F.col("path"), F.lit("/")))
    jobs = jobs.select("path", F.upper(F.split("path", "/")[0]).alias("stroke_type"), F.regexp_replace("path", r"\.[^./]+$", ".json").alias("output"))
    return jobs if done is None else jobs.join(done.select("output"), "output", "left_anti").select("path", "stroke_type", "output")


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Lists the files without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "").alias("path"))


def explode_clicks(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Clicked court points to rows joined with the named world points; unknown names are left out. ``docs``: camera_id, body."""
    rows = docs.select("camera_id", F.from_json("body", CLICKS_SCHEMA).alias("d")).select("camera_id", F.explode("d.points").alias("p")).select("camera_id", "p.*")
    return rows.join(F.broadcast(named), "feature")


def class_of(name: Column) -> Column:
    """Detector class names to ball, racket or person."""
    low = F.lower(name)
    return F.when(low.contains("ball"), "ball").when(low.contains("racket"), "racket").when(low.contains("person") | low.contains("player"), "person")


def boxes_by_frame(docs: DataFrame, keys: list[str]) -> DataFrame:
    """JSON maps ``{frame: [x, y, w, h]}`` in ``body`` to one row per frame."""
    rows = docs.select(*keys, F.explode(F.from_json("body", "map<string,array<int>>")).alias("frame", "b"))
    return rows.select(*keys, F.col("frame").cast("int").alias("frame"), *[F.element_at("b", i + 1).alias(c) for i, c in enumerate("xywh")])


HIT_FEATURES = ["wrist_speed", "ball_dist", "ball_vel_before", "ball_vel_after", "ball_vel_change", "ball_angle_change", "racket_dist"]


def read_hit_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Labelled hit candidates for training from CSV: ``is_hit, frame, confidence`` and the features; rows without a label are dropped, unknown
    features are 0."""
    rows = trimmed(spark.read.schema(_text_schema(["is_hit", "frame", "confidence", *HIT_FEATURES])).option("header", True).csv(path))
    rows = rows.select(number(F.col("is_hit")).cast("int").alias("is_hit"), number(F.col("frame")).cast("int").alias("frame"), "confidence", *[F.col(c).try_cast("double").alias(c) for c in HIT_FEATURES])
    return rows.filter(F.col("is_hit").isNotNull()).na.fill(0.0, subset=HIT_FEATURES)


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """A landmark table (``clip_id, frame, t_ms, lm_id, x, y, z, vis``) with one form for what was not found: axes NULL together, visibility 0.

    A frame without a person has NULL or NaN axes, whatever its visibility says."""
    p = spark.read.parquet(path)
    axes = [F.nullif(F.col(a).cast("double"), F.lit(float("nan"))).alias(a) for a in "xyz"]
    p = p.select("clip_id", F.col("frame").cast("int").alias("frame"), F.col("t_ms").cast("double").alias("t_ms"), F.col("lm_id").cast("int").alias("lm_id"), *axes, F.nullif(F.col("vis").cast("double"), F.lit(float("nan"))).alias("vis"))
    found = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return p.withColumns({a: F.when(found, F.col(a)) for a in "xyz"} | {"vis": F.when(found, F.coalesce("vis", F.lit(0.0))).otherwise(0.0)})
