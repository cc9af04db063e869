"""The hit stream with event-time timers: reordering across micro-batches, release of held hits and outer joins by the watermark.

A clip's hits wait in a reorder buffer until the watermark has passed them, so a frame that comes in a later micro-batch
takes its place as long as it is no later than the allowed delay; later ones are dropped and counted by Spark (``late_rows``). Each
clip has at most one timer: at its earliest waiting hit, or at the moment from which nothing can replace the hit it
holds. When that fires the hit goes out and the clip's state is cleared, so clips that have ended leave nothing behind and no row
has to close them. (Time to live of state is a processing-time feature; in event time the timers are what ends state.)

The watermark moves with the newest row of any clip. Rows without a frame are clock ticks: they move it and are nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HIT = "ms long, frame int, rank int, x double"


def with_state_store(spark: SparkSession) -> None:
    """Named state variables and timers need the RocksDB state store; a session that has chosen another is left as it is."""
    if "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)


class KeepApart(StatefulProcessor):
    """Hits at least ``gap`` frames apart, the better of two nearer ones; see ``operators.fold.fold_kept`` for the batch form."""

    def __init__(self, gap: int, frame_ms: float):
        self.gap, self.gap_ms = gap, int(-(-gap * frame_ms // 1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", HIT)
        self.held = handle.getValueState("held", HIT)
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            part = part[part["frame"].notna() & part["rank"].notna()]
            new += [(int(ms), int(f), int(r), float(x)) for ms, f, r, x in zip(part["ms"], part["frame"], part["rank"], part["x"])]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        yield self._table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((r for r in waiting if r[0] <= now), key=lambda r: (r[1], r[2], r[3]))
        later = [r for r in waiting if r[0] > now]
        held = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for hit in ripe:
            if held is None or hit[1] - held[1] >= self.gap:
                out += [held] if held else []
                held = hit
            elif hit[2:] > held[2:]:
                held = hit
        if held and held[0] + self.gap_ms <= now:  # whatever comes now is far enough away
            out.append(held)
            held = None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if held:
            self.held.update(held)
        else:
            self.held.clear()
        due = [r[0] for r in later] + ([held[0] + self.gap_ms] if held else [])
        if due:
            self._wake(min(due))
        yield self._table(key, out)

    def close(self) -> None:
        pass

    def _wake(self, ms: int) -> None:
        """One timer a clip, at the earliest moment that matters."""
        at = self.timer.get()[0] if self.timer.exists() else None
        if at is None or ms < at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _table(self, key, hits) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *h[1:]) for h in hits], columns=["clip_id", "frame", "rank", "x"])


def keep_apart(hits: DataFrame, gap: int, frame_ms: float, delay: str) -> DataFrame:
    """``hits``: clip_id long, ts, frame, rank, x, in any order within ``delay``. Returns clip_id, frame, rank, x of the hits kept."""
    with_state_store(hits.sparkSession)
    rows = hits.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("clip_id").transformWithStateInPandas(KeepApart(gap, frame_ms), "clip_id long, frame int, rank int, x double", "Append", "EventTime")


def next_within(hits: DataFrame, bounces: DataFrame, frames: int, frame_ms: float, delay: str) -> DataFrame:
    """Every hit with each bounce at most ``frames`` after it; one without any comes out with a NULL once the watermark of both
    streams has passed its window. ``hits``: clip_id, ts, frame; ``bounces`` likewise. Returns clip_id, frame, bounce_frame."""
    h = hits.withWatermark("ts", delay)
    b = bounces.select(F.col("clip_id").alias("b_clip"), F.col("ts").alias("b_ts"), F.col("frame").alias("bounce_frame")).withWatermark("b_ts", delay)
    window = F.expr(f"interval {int(frames * frame_ms)} milliseconds")
    # null-safe: a plain comparison filters rows without a clip before their times have moved the watermark
    inside = F.col("clip_id").eqNullSafe(F.col("b_clip")) & (F.col("b_ts") > F.col("ts")) & (F.col("b_ts") <= F.col("ts") + window)
    return h.join(b, inside, "leftOuter").select("clip_id", "frame", "bounce_frame")


def first_bounces(joined: DataFrame) -> DataFrame:
    """The first bounce of every hit, from the stored output of ``next_within``; ticks are left out."""
    return joined.filter("clip_id is not null").groupBy("clip_id", "frame").agg(F.min("bounce_frame").alias("next_frame"))


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark and were dropped, over a query's micro-batches."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))


def state_rows(progress: list[dict]) -> int:
    """Rows of state after the last micro-batch."""
    return sum(int(op.get("numRowsTotal", 0)) for op in progress[-1].get("stateOperators", [])) if progress else 0
