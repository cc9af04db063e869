"""Structured Streaming forms of the causal operators: the same rules as in batch, with state and watermarks.

Late rows beyond the watermark are dropped by Spark and shown in the query's progress. Stateful functions sort the rows of
a micro-batch by time within their key; each key's state is small (open tracks, one filter, one held event).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import Matcher


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, file or folder, as a stream of files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


class Arrivals:
    """A stored table that arrives in slices by ``order``: every slice is written when it is added, and a stream over the folder
    takes about one slice a micro-batch, in the order of arrival."""

    def __init__(self, rows: DataFrame, path: str, order: str, slices: int):
        bounds = rows.approxQuantile(order, [k / slices for k in range(1, slices)], 0.01) if slices > 1 else []
        place = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
        self.rows, self.path = rows.withColumn("_slice", place), path
        self.files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(self, k: int) -> None:
        self.rows.filter(F.col("_slice") == k).drop("_slice").repartition(self.files).write.mode("append").parquet(self.path)

    def tick(self, moment: DataFrame) -> None:
        """A last arrival that holds nothing but event times (``moment``: the columns of ``rows`` that are known)."""
        known = {c: F.col(c) if c in moment.columns else F.lit(None) for c in self.rows.columns if c != "_slice"}
        kinds = dict(self.rows.dtypes)
        moment.select(*[v.cast(kinds[c]).alias(c) for c, v in known.items()]).repartition(self.files).write.mode("append").parquet(self.path)

    def stream(self, by_slice: bool = True) -> DataFrame:
        reader = self.rows.sparkSession.readStream.schema(self.rows.drop("_slice").schema)
        return (reader.option("maxFilesPerTrigger", self.files) if by_slice else reader).parquet(self.path)


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows and mean value per key and window of fixed width."""
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events without a pause of ``gap``."""
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), "n")


def match_tracks(boxes: DataFrame, reach: float, patience: int) -> DataFrame:
    """Boxes to tracks per clip; state: the open tracks and the next id. ``boxes``: clip_id long, frame, box_idx, cx, cy."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, xs, ys, last, next_id = state.get if state.exists else ([], [], [], [], 0)
        m = Matcher(reach, patience, {t: (x, y, f) for t, x, y, f in zip(ids, xs, ys, last)}, next_id)
        rows = []
        for frame, g in pd.concat(list(batches)).sort_values(["frame", "box_idx"]).groupby("frame", sort=True):
            rows += m.frame(int(frame), list(g[["box_idx", "cx", "cy"]].itertuples(index=False, name=None)))
        state.update((list(m.tracks), *[[float(v[i]) for v in m.tracks.values()] for i in (0, 1)], [int(v[2]) for v in m.tracks.values()], m.next_id))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["clip_id", "frame", "box_idx", "track_id", "cx", "cy"])

    return boxes.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, frame int, box_idx long, track_id int, cx double, cy double", "ids array<int>, xs array<double>, ys array<double>, last array<int>, next_id int", "append", GroupStateTimeout.NoTimeout)


def one_euro(points: DataFrame, min_cutoff: float = 1.0, beta: float = 0.3, d_cutoff: float = 1.0) -> DataFrame:
    """One-Euro filter per key; state: last time, value and speed. ``points``: clip_id long, frame long, t_s double, x double."""
    alpha = lambda cutoff, dt: 1 / (1 + 1 / (6.283185307179586 * cutoff * dt))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, x, dx = state.get if state.exists else (None, None, 0.0)
        rows = []
        for frame, now, v in pd.concat(list(batches)).sort_values("frame")[["frame", "t_s", "x"]].itertuples(index=False, name=None):
            if pd.notna(v):
                if x is None:
                    x = v
                else:
                    dt = max(now - t, 1e-6)
                    d = alpha(d_cutoff, dt)
                    dx = d * (v - x) / dt + (1 - d) * dx
                    a = alpha(min_cutoff + beta * abs(dx), dt)
                    x = a * v + (1 - a) * x
                t = now
            rows.append((key[0], int(frame), x))
        state.update((t, x, dx))
        yield pd.DataFrame(rows, columns=["clip_id", "frame", "smooth"])

    return points.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, frame long, smooth double", "t double, x double, dx double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Runs a streaming query over all there is and returns its rows. A batch writes its own folder, so a repeated batch
    replaces its rows; ``complete`` keeps the last result only. ``progress`` takes the reports of the micro-batches."""
    spark = stream.sparkSession
    schema = stream.schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress.extend(json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress)
    out = spark.read.schema(schema).parquet(f"{path}/rows")
    return out if mode == "complete" else out.select(*schema.names)
