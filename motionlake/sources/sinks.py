"""Writers. All are idempotent: a rerun replaces what it wrote for the same keys instead of adding to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import STROKE_TYPES


def stroke_documents(strokes: DataFrame, keyframes: DataFrame, offsets: DataFrame) -> DataFrame:
    """One nested row per stroke; keyframes are shifted from the window to the session by its offset, missing ones stay NULL.

    ``strokes``: stroke_id, stroke_type and metric columns; ``keyframes``: stroke_id, name, frame_index, timestamp_ms;
    ``offsets``: stroke_id, frame_offset, offset_ms. An unknown stroke type raises an error."""
    k = keyframes.join(offsets, "stroke_id")
    moved = F.struct("name", (F.col("frame_index") + F.col("frame_offset")).alias("frame_index"), F.round(F.col("timestamp_ms") + F.col("offset_ms"), 2).alias("timestamp_ms"), F.col("frame_index").isNotNull().alias("detected"))
    k = k.groupBy("stroke_id").agg(F.array_sort(F.collect_list(moved)).alias("keyframes"))
    known = F.when(F.col("stroke_type").isin(*STROKE_TYPES), F.col("stroke_type")).otherwise(F.raise_error(F.concat(F.lit("unknown stroke type "), F.coalesce("stroke_type", F.lit("NULL")))))
    metrics = F.struct(*[c for c in strokes.columns if c not in ("stroke_id", "stroke_type")])
    return strokes.select("stroke_id", known.alias("stroke_type"), metrics.alias("metrics")).join(k, "stroke_id", "left")


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines with explicit NULLs: a field is never left out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def batch_summary(jobs: DataFrame) -> DataFrame:
    """total, ok, failed, counts by action and the failed paths. ``jobs``: path, ok, action."""
    by = jobs.filter("ok").groupBy("action").count()
    actions = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "count")))).alias("by_action"))
    totals = jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return totals.crossJoin(actions)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of the keys in ``df`` and leaves the others: a rerun of a clip does not duplicate its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def frames_for_labelling(labels: DataFrame, around: int, step: int) -> DataFrame:
    """Frames around each impact for labelling, within the clip. ``labels``: clip_id, impact_ms, fps, frame_count."""
    at = F.round(F.col("impact_ms") / 1000 * F.col("fps")).cast("int")
    rows = labels.select("clip_id", "frame_count", at.alias("impact"), F.explode(F.sequence(at - around, at + around, F.lit(step))).alias("frame"))
    return rows.filter((F.col("frame") >= 0) & (F.col("frame") < F.col("frame_count"))).select("clip_id", "impact", "frame")


def report_lines(accuracy: DataFrame) -> DataFrame:
    """The accuracy table as Markdown rows, in order."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all"))
    return accuracy.select(cell("stroke_type").alias("stroke_type"), cell("keyframe").alias("keyframe"), F.format_string("| %s | %s | %d | %.3f | %.1f |", cell("stroke_type"), cell("keyframe"), F.col("n"), F.coalesce("accuracy", F.lit(float("nan"))), F.coalesce("mae_ms", F.lit(float("nan")))).alias("line"))


def write_camera_poses(poses: DataFrame, path: str, width: int, height: int) -> None:
    """One JSON record a camera: its pose (null where it was not solved), score, picture size and number of clicks."""
    pose = F.struct("height_m", "distance_m", "tilt_deg", "pan_deg", F.col("focal_px").alias("focal_length_px"))
    rows = poses.select("camera_id", F.when(F.col("height_m").isNotNull(), pose).alias("camera_pose"), "score", F.lit(width).alias("frame_width"), F.lit(height).alias("frame_height"), F.col("clicks").alias("n_points"), "warnings")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
