"""Registered streaming and learning queries. Where the batch form has SQL, the stream is held against the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ml_gate
from ..operators import evaluation
from ..sources.adapters import view
from ..sources.scratch import scratch_path
from ..streaming import hits, jobs
from . import joins
from . import series as batch
from .series import r6


def _events(spark, d):
    return jobs.read_table(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _stored(spark, df, name, slices=3):
    """A batch view as a stream: its rows arrive in ``slices`` micro-batches, in the order of ``frame``."""
    arrivals = jobs.Arrivals(df, scratch_path(spark, name), "frame", slices)
    for k in range(slices):
        arrivals.add(k)
    return arrivals.stream()


def st8_stream_counts(spark, d):
    s = jobs.tumbling_counts(_events(spark, d), "ts", ["event_type"], "1 day", "2 days")
    return jobs.run_available(s, scratch_path(spark, "st8"), "complete").select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def st5_stream_sessions(spark, d):
    s = jobs.sessions(_events(spark, d), "ts", ["user_id"], "12 hours", "1 day")
    out = jobs.run_available(s, scratch_path(spark, "st5"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


#: When the streams begin (Spark takes rows at the epoch itself for late), milliseconds of a frame, and how late a row may come.
START_MS, FRAME_MS, DELAY = 946_684_800_000, 100, "3 seconds"


def _clocked(spark, tables, build, name, slices=3):
    """Runs ``build`` over frame tables that arrive in ``slices`` micro-batches by frame, every seventh row 20 frames late, then
    two clock ticks (what any other running clip would bring): the first moves the watermark past the end, the second lets it act. The query
    is stopped after every slice and started again from its checkpoint."""
    arrivals = []
    for i, df in enumerate(tables):
        delayed = F.pmod(F.hash("clip_id", "frame"), F.lit(7)) == 0
        rows = df.withColumn("ts", F.timestamp_millis(START_MS + F.col("frame").cast("long") * FRAME_MS)).withColumn("late", F.when(delayed, F.col("frame") + 20).otherwise(F.col("frame")))
        arrivals.append(jobs.Arrivals(rows, scratch_path(spark, f"{name}-{i}"), "late", slices))
    path = scratch_path(spark, name)
    for k in range(slices + 2):
        for a in arrivals:
            if k < slices:
                a.add(k)
            else:
                a.tick(a.rows.agg(F.timestamp_add("hour", F.lit(k), F.max("ts")).alias("ts")))
        out = jobs.run_available(build(*(a.stream(False).drop("late") for a in arrivals)), path)
    return out


def st6_stream_next_within(spark, d):
    s = view(spark, d, "sig").select("clip_id", "frame", "x")
    out = _clocked(spark, [s.filter("x > 50"), s.filter("x < 10")], lambda h, b: hits.next_within(h, b, 4, FRAME_MS, DELAY), "st6")
    return hits.first_bounces(out).withColumn("next_frame", F.col("next_frame").cast("double"))


def st1_stream_one_euro(spark, d):
    s = view(spark, d, "sig").select("clip_id", F.col("frame").cast("long").alias("frame"), (F.col("t_ms") / 3_600_000).alias("t_s"), "x")
    return r6(jobs.run_available(jobs.one_euro(_stored(spark, s, "st1-in")), scratch_path(spark, "st1")), "smooth")


def st4_stream_keep_apart(spark, d):
    """No row closes a clip: held hits come out by their timers, and hits that arrive a micro-batch late take their place."""
    s = view(spark, d, "sig").filter("x is not null").select(F.col("clip_id").cast("long").alias("clip_id"), "frame", (F.col("x") / 30).cast("int").alias("rank"), "x")
    return r6(_clocked(spark, [s], lambda r: hits.keep_apart(r, 4, FRAME_MS, DELAY), "st4"), "x")


def st2_stream_match_tracks(spark, d):
    b = view(spark, d, "boxes").filter("class = 'person'").select(F.col("clip_id").cast("long").alias("clip_id"), "frame", F.col("box_key").alias("box_idx"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    return r6(jobs.run_available(jobs.match_tracks(_stored(spark, b, "st2-in"), 960 * 0.12, 15), scratch_path(spark, "st2")), "cx", "cy")


def st7_stream_resume(spark, d):
    """The One-Euro stream, stopped after the first slice and started again from its checkpoint when the others have arrived."""
    s = view(spark, d, "sig").select("clip_id", F.col("frame").cast("long").alias("frame"), (F.col("t_ms") / 3_600_000).alias("t_s"), "x")
    arrivals, out = jobs.Arrivals(s, scratch_path(spark, "st7-in"), "frame", 3), scratch_path(spark, "st7")
    arrivals.add(0)
    jobs.run_available(jobs.one_euro(arrivals.stream()), out)
    arrivals.add(1)
    arrivals.add(2)
    return r6(jobs.run_available(jobs.one_euro(arrivals.stream()), out), "smooth")


def d_ml_hit_gate(spark, d):
    from .tracking import d_hitf_hit_features

    f = d_hitf_hit_features(spark, d).withColumn("confidence", F.lit("MEDIUM")).withColumn("is_hit", (F.col("ball_angle_change") < 0.2).cast("int"))
    train, test = f.filter("pmod(hash(clip_id, frame), 5) > 0"), f.filter("pmod(hash(clip_id, frame), 5) = 0")
    kept = ml_gate.gate(test, ml_gate.train(train))
    rows = test.join(kept.select("clip_id", "frame", F.lit(1).alias("k")), ["clip_id", "frame"], "left").withColumn("called", F.coalesce("k", F.lit(0)))
    return r6(evaluation.classification_report(rows, "is_hit", "called"), "precision", "recall", "f1")


QUERIES = {f.__name__: f for f in (st8_stream_counts, st5_stream_sessions, st6_stream_next_within, st1_stream_one_euro, st4_stream_keep_apart, st2_stream_match_tracks, st7_stream_resume, d_ml_hit_gate)}

ORACLE_SQL = {
    "st8_stream_counts": "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1, 2",
    "st5_stream_sessions": """with r as (select *, sum(coalesce((epoch_us(ts) - last >= 43200000000)::INT, 0)) over (partition by user_id order by ts, event_id) as run from (select *, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as last from events)),
s as (select user_id, run, count(*) as n from r group by user_id, run) select user_id, count(*) as sessions, max(n) as longest from s group by user_id""",
    "st6_stream_next_within": joins.ORACLE_SQL["jn3_next_within"],
    "st1_stream_one_euro": batch.ORACLE_SQL["st1_one_euro"],
    "st7_stream_resume": batch.ORACLE_SQL["st1_one_euro"],
    "st4_stream_keep_apart": batch.ORACLE_SQL["wn22_hit_dedup"],
}
