"""Per-session blocks over a strokes table: aggregates, trends, patterns, summary, and the session document.

Every block is one pass of grouped or windowed aggregates keyed by session; nothing is collected but each session's own
strokes for the document. Standard deviations are those of the population. A trend needs three known values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stroke types in their reporting order, and the thresholds of the rules below.
STROKE_TYPES = ("FH", "BH", "SV", "VL", "SL", "RS")
STABLE, VOLATILE = 0.05, 0.10
POOR, FAIR, GOOD = 0.4, 0.6, 0.8
#: Series of the trend block and whether larger is better; split_step counts 1 or 0 for a stroke, where it is known.
TRENDS = (("shoulder_deg", True), ("tempo", True), ("recovery_ms", False), ("split_step", True))
AUTO_ACCEPT, REVIEW, DEMOTE_BELOW = 0.85, 0.60, 0.70
AVOID_SHARE, AVOID_STROKES = 0.20, 20
LOW_CONFIDENCE_SHARE = 0.30
#: What to train for an issue.
DRILLS = {"shoulder_deg": "shoulder_rotation", "tempo": "tempo_ratio", "recovery_ms": "recovery_time", "split_step": "split_step_rate"}
SESSION = ["session_id"]


def type_position(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in STROKE_TYPES]), col)


def recommended_action(confidence: Column) -> Column:
    """auto_accept, coach_review or discard by confidence; NULL is discarded."""
    return F.when(confidence >= AUTO_ACCEPT, "auto_accept").when(confidence >= REVIEW, "coach_review").otherwise("discard")


def demote(action: Column, classification_confidence: Column) -> Column:
    """An automatic accept needs a sure stroke type."""
    return F.when((action == "auto_accept") & (classification_confidence < DEMOTE_BELOW), "coach_review").otherwise(action)


def keep_and_number(strokes: DataFrame) -> DataFrame:
    """Drops discarded strokes and numbers the others from 1 in their order."""
    kept = strokes.withColumn("action", recommended_action(F.col("confidence"))).filter("action <> 'discard'")
    return kept.withColumn("kept_index", F.row_number().over(Window.partitionBy(*SESSION).orderBy("stroke_index")))


def type_override(strokes: DataFrame, overrides: DataFrame) -> DataFrame:
    """The stroke type of a table of corrections (``session_id, stroke_index, stroke_type``) before the classified one."""
    o = overrides.select(*SESSION, "stroke_index", F.col("stroke_type").alias("_type"))
    return strokes.join(o, [*SESSION, "stroke_index"], "left").withColumn("stroke_type", F.coalesce("_type", "stroke_type")).drop("_type")


def by_type(strokes: DataFrame) -> DataFrame:
    """Clean strokes per session and type: counts, means, population deviations, split-step rate in percent of known ones."""
    return strokes.filter("is_clean").groupBy(*SESSION, "stroke_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("shoulder_deg").alias("mean_shoulder"), F.stddev_pop("shoulder_deg").alias("sd_shoulder"),
        F.avg("tempo").alias("mean_tempo"), F.stddev_pop("tempo").alias("sd_tempo"),
        F.avg("hip_deg").alias("mean_hip"), F.avg("contact_cm").alias("mean_contact_height"), F.avg("path_deg").alias("mean_swing_path"), F.avg("racket_mps").alias("mean_racket_speed"),
        F.avg("recovery_ms").alias("mean_recovery"), (F.avg(F.col("split_step").cast("double")) * 100).alias("split_step_rate"),
    )


def session_stats(strokes: DataFrame) -> DataFrame:
    """Windows, usable strokes and the stroke-type distribution of each session, as JSON text in type order."""
    counts = strokes.groupBy(*SESSION, "stroke_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_clean").alias("clean"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct(type_position(F.col("stroke_type")).alias("p"), "stroke_type", "n"))), lambda x: F.struct(x["stroke_type"], x["n"]))
    return counts.groupBy(*SESSION).agg(F.sum("n").alias("windows"), F.sum("clean").alias("usable"), F.to_json(F.map_from_entries(entries)).alias("distribution"))


def share_of_max(strokes: DataFrame, value: str, out: str) -> DataFrame:
    """Absolute value in percent of the session's largest absolute value; NULL where that is 0."""
    top = F.max(F.abs(value)).over(Window.partitionBy(*SESSION))
    return strokes.withColumn(out, F.when(top > 0, F.abs(value) / top * 100))


def trend(strokes: DataFrame, value: str, higher_is_better: bool) -> DataFrame:
    """``first, mid, last`` (means of thirds of the known values) and ``trend`` per session."""
    w = Window.partitionBy(*SESSION).orderBy("stroke_index")
    k = strokes.withColumn(value, F.col(value).cast("double")).filter(F.col("is_clean") & F.col(value).isNotNull()).withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SESSION)))
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    means = k.groupBy(*SESSION).agg(
        F.max("_n").alias("n"),
        F.avg(F.when(F.col("_at") <= third, F.col(value))).alias("first"),
        F.avg(F.when((F.col("_at") > third) & (F.col("_at") <= F.col("_n") - third), F.col(value))).alias("mid"),
        F.avg(F.when(F.col("_at") > F.col("_n") - third, F.col(value))).alias("last"),
    )
    means = means.withColumn("mid", F.coalesce("mid", "first"))
    base = F.abs("first") + F.lit(1e-9)
    change, middle = (F.col("last") - F.col("first")) / base, F.abs(F.col("mid") - F.col("first")) / base
    better = change > 0 if higher_is_better else change < 0
    level = F.abs(change) < STABLE  # only where the ends agree can the middle make it volatile
    name = F.when(F.col("n") < 3, "stable").when(level & (middle > VOLATILE), "volatile").when(level, "stable").when(better, "improving").otherwise("declining")
    return means.select(*SESSION, "n", "first", "mid", "last", name.alias("trend"))


def consistency(strokes: DataFrame, values: list[str]) -> DataFrame:
    """1 less the mean coefficient of variation of the series with three known values and a mean off 0, within 0 and 1."""
    stats = strokes.filter("is_clean").groupBy(*SESSION).agg(*[F.when((F.count(v) >= 3) & (F.abs(F.avg(v)) > 1e-9), F.stddev_pop(v) / F.abs(F.avg(v))).alias(f"cv_{v}") for v in values])
    known = F.array_compact(F.array(*[F.col(f"cv_{v}") for v in values]))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return stats.select(*SESSION, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)).alias("consistency"))


def _trend_of(n: Column, first: Column, mid: Column, last: Column, higher_is_better: bool) -> Column:
    """Trend by the means of thirds: stable, volatile, improving or declining."""
    base = F.abs(first) + F.lit(1e-9)
    change, middle = (last - first) / base, F.abs(F.coalesce(mid, first) - first) / base
    better = change > 0 if higher_is_better else change < 0
    level = F.abs(change) < STABLE  # only where the ends agree can the middle make it volatile
    return F.when(n < 3, "stable").when(level & (middle > VOLATILE), "volatile").when(level, "stable").when(better, "improving").otherwise("declining")


def blocks(strokes: DataFrame) -> DataFrame:
    """Everything the trend, pattern and summary blocks say, one row a session: strokes are dealt by session and numbered once, and all
    else is one conditional aggregate over that."""
    whole, w = Window.partitionBy(*SESSION), Window.partitionBy(*SESSION).orderBy("stroke_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    clean = F.coalesce(F.col("is_clean"), F.lit(False))
    rows = strokes.withColumn("_clean", clean).withColumns({f"_v_{v}": F.when(clean, F.col(v).cast("double")) for v, _ in TRENDS})
    flags = {"clean": F.col("_clean"), **{v: F.col(f"_v_{v}").isNotNull() for v, _ in TRENDS}}
    rows = rows.withColumns({f"_at_{k}": F.sum(f.cast("int")).over(upto) for k, f in flags.items()} | {f"_n_{k}": F.sum(f.cast("int")).over(whole) for k, f in flags.items()})
    rows = rows.withColumn("_run", F.sum(F.col("stroke_type").isin("FH", "BH").cast("int")).over(w.rowsBetween(-2, 0)))
    third = lambda k: F.greatest(F.lit(1), F.floor(F.col(f"_n_{k}") / 3))
    aggregates = [F.max(f"_n_{k}").alias(f"n_{k}") for k in flags]
    for v, _ in TRENDS:
        at, n, x = F.col(f"_at_{v}"), F.col(f"_n_{v}"), F.col(f"_v_{v}")
        aggregates += [F.avg(F.when(at <= third(v), x)).alias(f"first_{v}"), F.avg(F.when((at > third(v)) & (at <= n - third(v)), x)).alias(f"mid_{v}"), F.avg(F.when(at > n - third(v), x)).alias(f"last_{v}")]
        aggregates += [F.avg(x).alias(f"mean_{v}"), F.stddev_pop(x).alias(f"sd_{v}")]
    counts = F.array(*[F.struct(F.count_if(F.col("stroke_type") == t).alias("n"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(STROKE_TYPES)])
    a = rows.groupBy(*SESSION).agg(
        *aggregates, F.count(F.lit(1)).alias("strokes"), F.array_max(counts)["t"].alias("dominant"), F.count_if(F.col("stroke_type") == "BH").alias("backhands"), F.coalesce(F.bool_or(F.col("_run") == 3), F.lit(False)).alias("ground_run"),
        F.max(F.when(F.col("_clean") & (F.col("_at_clean") == F.col("_n_clean") - third("clean") + 1), F.col("stroke_index"))).alias("_onset"),
        F.max_by("stroke_index", F.when(F.col("_clean"), F.struct("confidence", -F.col("stroke_index")))).alias("highlight"), F.avg((F.col("confidence") < REVIEW).cast("double")).alias("low_share"),
    )
    a = a.withColumns({f"{v}_trend": F.when(F.col(f"n_{v}") > 0, _trend_of(F.col(f"n_{v}"), F.col(f"first_{v}"), F.col(f"mid_{v}"), F.col(f"last_{v}"), up)).otherwise("stable") for v, up in TRENDS})
    # a coefficient of variation needs three known values and a mean off 0
    spread = F.array_compact(F.array(*[F.when((F.col(f"n_{v}") >= 3) & (F.abs(f"mean_{v}") > 1e-9), F.col(f"sd_{v}") / F.abs(f"mean_{v}")) for v in ("shoulder_deg", "tempo", "recovery_ms")]))
    mean = F.when(F.size(spread) > 0, F.aggregate(spread, F.lit(0.0), lambda s, x: s + x) / F.size(spread))
    declining = sum(((F.col(f"{v}_trend") == "declining").cast("int") for v, _ in TRENDS[1:]), (F.col(f"{TRENDS[0][0]}_trend") == "declining").cast("int"))
    a = a.withColumn("known", F.greatest(*[F.col(f"n_{v}") for v, _ in TRENDS]) > 0).withColumn("consistency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean))).withColumn("fatigue", F.when(F.col("known"), declining >= 2))
    a = a.withColumn("fatigue_onset", F.when(F.col("fatigue"), F.col("_onset"))).withColumn("avoids_backhand", F.when(F.col("strokes") >= AVOID_STROKES, F.col("backhands") / F.col("strokes") < AVOID_SHARE))
    issue = F.coalesce(*[F.when(F.col(f"{v}_trend") == "declining", F.lit(v)) for v, _ in TRENDS])
    score = F.round("consistency", 2)
    quality = F.when((score < POOR) | (score.isNotNull() & F.col("fatigue")), "poor").when(score < FAIR, "fair").when(score <= GOOD, "good").when(score.isNotNull(), "excellent")
    a = a.withColumn("primary_issue", F.when(F.col("known"), issue)).withColumn("quality", quality)
    # the drill that goes with the issue: its series' name, or none
    a = a.withColumn("drill_tag", F.coalesce(*[F.when(F.col("primary_issue") == v, F.lit(t)) for v, t in DRILLS.items()]))
    coach = F.coalesce(F.col("quality") == "poor", F.lit(False)) | F.coalesce("fatigue", F.lit(False)) | (F.col("low_share") > LOW_CONFIDENCE_SHARE)
    return a.withColumn("coach_flag", coach)


TREND_FIELDS = [*(f"{v}_trend" for v, _ in TRENDS), "consistency", "fatigue", "fatigue_onset"]
PATTERN_FIELDS = ["dominant", "ground_run", "avoids_backhand", "strokes"]
SUMMARY_FIELDS = ["clean", "highlight", "primary_issue", "quality", "coach_flag", "fatigue", "fatigue_onset"]


def trend_block(strokes: DataFrame) -> DataFrame:
    """Trends of rotation, tempo, recovery and split-step rate, consistency, fatigue (two or more declining) and the stroke where its last third begins."""
    return blocks(strokes).filter("known").select(*SESSION, *TREND_FIELDS)


def pattern_block(strokes: DataFrame) -> DataFrame:
    """Dominant type (ties to the reporting order), a ground-stroke run of three, avoided backhand (NULL for few strokes)."""
    return blocks(strokes).select(*SESSION, *PATTERN_FIELDS)


def summary_block(strokes: DataFrame) -> DataFrame:
    """Quality by consistency (poor with fatigue, NULL without consistency), first declining trend, the clean stroke of highest
    confidence, and whether a coach should look: poor quality, fatigue, or many strokes under the review threshold."""
    return blocks(strokes).withColumn("clean", F.col("n_clean").cast("long")).select(*SESSION, *SUMMARY_FIELDS)


def documents(strokes: DataFrame) -> DataFrame:
    """One nested row per session: its strokes in order, the aggregates by type in reporting order, trend and pattern."""
    items = strokes.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("stroke_index", "stroke_type", "is_clean", "shoulder_deg", "tempo", "confidence"))).alias("strokes"))
    agg, b = by_type(strokes), blocks(strokes)
    agg = agg.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct(type_position(F.col("stroke_type")).alias("position"), "stroke_type", "n", "mean_shoulder", "mean_tempo"))).alias("aggregated_metric"))
    layers = b.select(
        *SESSION, F.when(F.col("known"), F.struct(*TREND_FIELDS)).alias("trend"), F.struct(*PATTERN_FIELDS).alias("pattern"),
        F.struct(F.col("n_clean").alias("clean"), *[c for c in SUMMARY_FIELDS if c != "clean"], "drill_tag").alias("session_summary"),
        F.struct(F.col("strokes").alias("total_strokes_detected"), F.col("n_clean").alias("usable_strokes")).alias("session_metadata"),
    )
    return items.join(agg, SESSION, "left").join(layers, SESSION, "left")
