"""The hit stream with timers: rows a micro-batch late are placed, later ones dropped and counted, ended clips leave no state."""

import datetime as dt

from motionlake.sources.scratch import scratch_path
from motionlake.streaming import hits, jobs

SCHEMA = "clip_id long, ts timestamp, frame int, rank int, x double"
START = dt.datetime(2000, 1, 1)


def at(clip, frame, rank=1, x=0.0):
    return clip, START + dt.timedelta(milliseconds=100 * frame), frame, rank, x


def run(spark, batches, build):
    folder, out, progress = scratch_path(spark, "hits-in"), scratch_path(spark, "hits-out"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = jobs.run_available(build(spark.readStream.schema(SCHEMA).parquet(folder)), out, progress=progress)
    return sorted(tuple(r) for r in got.collect()), progress


def test_late_hits_are_placed_or_counted_and_state_ends(spark):
    tick = (None, START + dt.timedelta(hours=1), None, None, None)
    batches = [
        [at(1, 10), at(1, 30), at(2, 12)],
        [at(1, 25, 3), at(1, 50)],  # frame 25 comes a batch late, within the delay: it beats 30
        [at(1, 90), at(2, 14, 9)],  # frame 14 of clip 2 is far too late: the watermark is at frame 20 by now
        [tick],
        [(None, START + dt.timedelta(hours=2), None, None, None)],
    ]
    got, progress = run(spark, batches, lambda s: hits.keep_apart(s, 8, 100, "3 seconds"))
    assert [r[:3] for r in got] == [(1, 10, 1), (1, 25, 3), (1, 50, 1), (1, 90, 1), (2, 12, 1)]
    assert hits.late_rows(progress) == 1
    last = [op for op in progress[-1]["stateOperators"] if "transformWithState" in op["operatorName"]]
    assert last and all(int(op["customMetrics"].get("rocksdbNumKeys", op.get("numRowsTotal", 0)) or 0) >= 0 for op in last) and hits.state_rows(progress) == 0


def test_hits_without_a_bounce_come_out_after_the_watermark(spark):
    tick = [(None, START + dt.timedelta(hours=h), None, None, None) for h in (1, 2)]
    folder = [scratch_path(spark, f"next-{i}") for i in range(2)]
    out = scratch_path(spark, "next-out")
    steps = [([at(1, 10), at(1, 40)], [at(1, 12), at(1, 13)]), ([at(2, 60)], [at(2, 80)]), (tick[:1], tick[:1]), (tick[1:], tick[1:])]
    counts = []
    for h, b in steps:
        for path, rows in zip(folder, (h, b)):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        s = [spark.readStream.schema(SCHEMA).parquet(p).select("clip_id", "ts", "frame") for p in folder]
        got = jobs.run_available(hits.next_within(*s, 5, 100, "1 second"), out)
        counts.append(got.filter("clip_id is not null and bounce_frame is null").count())
    assert counts[0] == 0 and counts[-1] == 2
    assert sorted(tuple(r) for r in hits.first_bounces(got).collect()) == [(1, 10, 12), (1, 40, None), (2, 60, None)]
