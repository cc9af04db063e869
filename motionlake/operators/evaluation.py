"""Accuracy reports: predictions against labels. Tables in, tables out; an accuracy over no case is NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins

SLACK_MS = 1.0
# Bins of the camera deviation in degrees.
DEVIATION_BINS = ((0.0, 15.0), (15.0, 30.0), (30.0, 999.0))


def keyframe_errors(labels: DataFrame, predictions: DataFrame, tolerance_frames: int) -> DataFrame:
    """A row for each usable label and labelled keyframe: ``clip_id, stroke_type, keyframe, error_ms, ok, reason``.

    ``labels``: clip_id, stroke_type, fps, usable, ``<keyframe>_frame``...; ``predictions``: clip_id, keyframe, detected, timestamp_ms.
    A missing or undetected prediction is a failure without an error."""
    frames = [c for c in labels.columns if c.endswith("_frame")]
    long = labels.filter("usable").select("clip_id", "stroke_type", "fps", F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_frame")).alias("keyframe"), F.col(c).cast("double").alias("frame")) for c in frames])).alias("k"))
    long = long.select("clip_id", "stroke_type", "fps", "k.*").filter(F.col("frame").isNotNull())
    rows = long.join(predictions, ["clip_id", "keyframe"], "left")
    seen = F.coalesce("detected", F.lit(False)) & F.col("timestamp_ms").isNotNull()
    error = F.when(seen, F.abs(F.col("timestamp_ms") - F.col("frame") * 1000 / F.col("fps")))
    ok = F.coalesce(error <= F.lit(tolerance_frames) * 1000 / F.col("fps") + SLACK_MS, F.lit(False))
    reason = F.when(F.col("detected").isNull(), "no prediction").when(~seen, "not detected").when(~ok, "off")
    return rows.select("clip_id", "stroke_type", "keyframe", error.alias("error_ms"), ok.alias("ok"), reason.alias("reason"))


def keyframe_accuracy(errors: DataFrame) -> DataFrame:
    """Accuracy and mean error per stroke type and keyframe, and over all rows (NULL, NULL), by grouping sets in one pass."""
    return errors.groupingSets([[F.col("stroke_type"), F.col("keyframe")], []], F.col("stroke_type"), F.col("keyframe")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("error_ms").alias("mae_ms"), F.count_if(F.col("reason") == "no prediction").alias("missing"))


def agreement(labels: DataFrame, task: str, order: str, columns: list[str], tolerance: int) -> DataFrame:
    """Share of values on which the first two annotators of a task agree within ``tolerance``, per column."""
    pairs = joins.first_two(labels, [task], [order], columns)
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").cast("double").alias("a"), F.col(f"{c}_b").cast("double").alias("b")) for c in columns])).alias("p")).select("p.*").filter("a is not null and b is not null")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.abs(F.col("a") - F.col("b")) <= tolerance).cast("double")).alias("agreement"))


def accuracy_by_deviation(rows: DataFrame) -> DataFrame:
    """Accuracy of ``ok`` in bins of ``deviation_deg``; empty bins stay, with n = 0."""
    spark = rows.sparkSession
    bins = spark.createDataFrame(list(DEVIATION_BINS), "low double, high double")
    counts = rows.join(F.broadcast(bins), (F.col("deviation_deg") >= F.col("low")) & (F.col("deviation_deg") < F.col("high"))).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    return bins.join(counts, ["low", "high"], "left").select("low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy")


def spotting(truth: DataFrame, found: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Recall of ``truth`` spans (start, end) and precision of ``found`` times (at) per key; a span counts once."""
    hits = joins.interval_join(found, truth, keys, "at", "start", "end", width)
    spans = truth.select(*keys, "start", "end").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"))
    times = found.select(*keys, "at").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"))
    got = hits.groupBy(*keys).agg(F.countDistinct("start", "end").alias("segments_hit"), F.countDistinct("at").alias("predictions_in"))
    out = spans.join(times, keys, "full").join(got, keys, "left").fillna(0, ["segments", "predictions", "segments_hit", "predictions_in"])
    return out.select(*keys, "segments", "predictions", F.when(F.col("segments") > 0, F.col("segments_hit") / F.col("segments")).alias("recall"), F.when(F.col("predictions") > 0, F.col("predictions_in") / F.col("predictions")).alias("precision"))


def classification_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one grouped confusion matrix."""
    cells = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).count()
    support = cells.groupBy(F.col("a").alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("count")).otherwise(0)).alias("hits"))
    called = cells.groupBy(F.col("p").alias("label")).agg(F.sum("count").alias("called"))
    out = support.join(called, "label", "full").fillna(0, ["support", "hits", "called"])
    precision, recall = F.when(F.col("called") > 0, F.col("hits") / F.col("called")), F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("called") + F.col("support"))).otherwise(0.0).alias("f1"))
