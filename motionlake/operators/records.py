"""Small relational operators: orders, choices, sample frames, reject tables, diagnostics, and SQL functions of the geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import body as B
from . import poses, series
from .poses import CLIP, at, mid

ROLES = ("near", "far", "other")
#: SQL functions: name, arguments, result type and body.
SQL_FUNCTIONS = (
    ("line_angle_deg", "dx DOUBLE, dy DOUBLE", "DOUBLE", "degrees(atan2(dy, dx)) - floor(degrees(atan2(dy, dx)) / 180) * 180"),
    ("rotation_deg", "dx DOUBLE, dz DOUBLE", "DOUBLE", "degrees(atan2(dz, abs(dx) + 1e-9))"),
    ("visibility_flag", "mean DOUBLE", "STRING", "CASE WHEN mean >= 0.8 THEN 'visible' WHEN mean >= 0.5 THEN 'low_confidence' ELSE 'not_detectable' END"),
)


def role_position(role: Column) -> Column:
    """near, far, then all others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0)), F.lit(len(ROLES)))


def in_role_order(players: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place``: players of a key near before far before other, then by track."""
    return players.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(role_position(F.col("role")), "track_id")))


def longest_track(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The track of most rows per key, ties to the smaller id: ``track_id, frames``."""
    n = obs.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("frames"))
    best = F.max(F.struct("frames", (-F.col("track_id")).alias("o"), "track_id")).alias("b")
    return n.groupBy(*keys).agg(best).select(*keys, "b.track_id", "b.frames")


def first_valid(attempts: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """The first attempt of each key that is valid, all its columns; a key without one has its first attempt and ``valid`` false."""
    rest = [c for c in attempts.columns if c not in keys]
    best = attempts.withColumn("_ok", F.coalesce(valid, F.lit(False))).groupBy(*keys).agg(F.min(F.struct((~F.col("_ok")).alias("_bad"), order, *[c for c in rest if c != order])).alias("b"))
    return best.select(*keys, *[f"b.{c}" for c in rest], (~F.col("b._bad")).alias("valid"))


def sample_frames(clips: DataFrame, count: int) -> DataFrame:
    """``count`` frames evenly from the first to the last of each clip (``clip_id, frames``): ``nth, frame``; repeats of short clips are one row."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("frames") - 1) / max(1, count - 1)).cast("int"))
    return clips.select(*CLIP, F.posexplode(F.array_distinct(steps)).alias("nth", "frame"))


def rejects(clips: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clips that break no rule; ``clip_id, reason`` of the others): a run over many clips goes on without the bad ones, and each
    names the first rule it breaks. A rule that is NULL is broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = clips.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select(*CLIP, "reason")


def diagnostics(frames: DataFrame) -> DataFrame:
    """Per frame: mean visibility of the core and of the wrists, body height in the picture, and speed of the hip centre a second."""
    f = frames.withColumn("_x", mid(23, 24, "x")).withColumn("_y", mid(23, 24, "y"))
    w = series.window(CLIP, ["frame"])
    step = B.norm(F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w))
    seconds = (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000
    height = F.abs(mid(27, 28, "y") - at(0, "y"))
    return f.select(*CLIP, "frame", poses.core_visibility().alias("core_vis"), ((at(15, "vis") + at(16, "vis")) / 2).alias("wrist_vis"), height.alias("height_frac"), F.when(seconds > 0, step / seconds).alias("hip_speed"))


def round2(x: Column) -> Column:
    """Two places; NaN is NULL."""
    return F.round(B.known(x), 2)


def aspect_corrected(x: Column, width: Column, height: Column) -> Column:
    """A normalised abscissa in the proportions of the picture."""
    return x * width / F.greatest(height, F.lit(1))


def frame_ms(frame: Column, fps: Column) -> Column:
    return frame * 1000 / fps


def ms_frame(ms: Column, fps: Column) -> Column:
    return F.round(ms / 1000 * fps).cast("int")


def labelled_candidates(table: DataFrame, features: list[str]) -> DataFrame:
    """Training rows of a hit-candidate table: unlabelled ones dropped, unknown features 0."""
    return table.na.drop(subset=["is_hit"]).na.fill(0.0, subset=features)


def register_sql(spark: SparkSession) -> None:
    """Makes the geometry callable from SQL, as SQL functions that the optimizer inlines."""
    for name, arguments, result, text in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {text}")
