"""Windowed time-series operators over rows keyed by ``keys`` and ordered by ``order``. Missing values are NULL.

All of them are built-in window expressions: one shuffle on the keys, shared by every operator that uses the same keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def window(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def gradient(df: DataFrame, keys: Names, order: Names, value: str, t: str, out: str, unit: float = 1.0) -> DataFrame:
    """Central difference over time, one-sided at the ends; NULL where a neighbour is missing. ``unit``: what of ``t`` makes one unit of time."""
    w = window(keys, order)
    side = lambda f, c: F.when(f(F.lit(1)).over(w).isNotNull(), f(c).over(w)).otherwise(F.col(c))
    df = df.withColumns({"_rise": side(F.lead, value) - side(F.lag, value), "_dt": side(F.lead, t) - side(F.lag, t)})
    return df.withColumn(out, F.when(F.col("_dt") != 0, F.col("_rise") / (F.col("_dt") / F.lit(unit)))).drop("_rise", "_dt")


def speed(df: DataFrame, keys: Names, order: Names, values: Names, t: str, out: str) -> DataFrame:
    """Norm of the gradients of several axes, in units per time unit."""
    names = [f"_{out}_{v}" for v in values]
    for v, n in zip(values, names):
        df = gradient(df, keys, order, v, t, n)
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))
    return df.withColumn(out, norm).drop(*names)


def neighbour_speed(df: DataFrame, keys: Names, order: Names, x: str, y: str, vis: str, least: float, out: str) -> DataFrame:
    """Half the distance between the rows before and after, where both are visible enough; NULL at the ends."""
    w = window(keys, order)
    dx, dy = F.lead(x).over(w) - F.lag(x).over(w), F.lead(y).over(w) - F.lag(y).over(w)
    seen = (F.lead(vis).over(w) > least) & (F.lag(vis).over(w) > least)
    return df.withColumn(out, F.when(seen, F.sqrt(dx * dx + dy * dy) / 2))


def moving_average(df: DataFrame, keys: Names, order: Names, value: str, half: int, out: str) -> DataFrame:
    """Mean of the known values of 2 * half + 1 rows, fewer at the ends."""
    return df.withColumn(out, F.avg(value).over(window(keys, order).rowsBetween(-half, half)))


def savgol_weights(size: int, degree: int = 2) -> list[list[float]]:
    """Row p: weights that give the fitted polynomial's value at position p of ``size`` equally spaced samples."""
    x = np.vander(np.arange(size), degree + 1).astype(float)
    return (x @ np.linalg.pinv(x)).tolist()


def savgol(df: DataFrame, keys: Names, order: Names, value: str, out: str, size: int = 7, degree: int = 2, mode: str = "whole") -> DataFrame:
    """Savitzky-Golay smoothing; the first and last ``size // 2`` rows take the polynomial fitted to the end window.

    ``mode="whole"`` smooths a series only if none of its values is missing; ``mode="per_run"`` smooths every row whose
    window is complete. A series shorter than ``size`` uses the longest odd length from 5 on, else it stays as it is.
    """
    w = window(keys, order)
    whole = Window.partitionBy(*keys)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    # each neighbour is one column, however many weights it meets
    around = {k: f"_by{k + size}" for k in range(1 - size, size) if k}
    df = df.withColumns({"_n": n, "_at": at, "_full": F.count(value).over(whole) == n} | {c: (F.lead(value, k) if k > 0 else F.lag(value, -k)).over(w) for k, c in around.items()})
    by = lambda k: F.col(around[k]) if k else F.col(value)
    smooth = F.lit(None).cast("double")
    for s in range(5 if size >= 5 else size, size + 1, 2):
        weights, half = savgol_weights(s, degree), s // 2
        middle = sum(by(i - half) * weights[half][i] for i in range(s))
        # ends: the same window seen from one of its outer positions
        edge = F.lit(None).cast("double")
        for p in range(half):
            head = sum(by(i - p) * weights[p][i] for i in range(s))
            q = s - 1 - p
            tail = sum(by(i - q) * weights[q][i] for i in range(s))
            edge = F.when(F.col("_at") == p + 1, head).when(F.col("_at") == F.col("_n") - p, tail).otherwise(edge)
        used = F.when((F.col("_at") > half) & (F.col("_at") <= F.col("_n") - half), middle).otherwise(edge)
        fits = F.col("_n") >= size if s == size else (F.col("_n") < size) & (F.col("_n") >= s) & (F.col("_n") < s + 2)
        smooth = F.when(fits, used).otherwise(smooth)
    df = df.withColumn("_smooth", smooth)
    ready = F.col("_full") if mode == "whole" else F.col("_smooth").isNotNull()
    return df.withColumn(out, F.when(ready & (F.col("_n") >= 5), F.col("_smooth")).otherwise(F.col(value))).drop("_n", "_at", "_full", "_smooth", *around.values())


def fill_gaps(df: DataFrame, keys: Names, order: Names, value: str, longest: int, out: str, edges: bool = True) -> DataFrame:
    """Linear interpolation by row of runs of at most ``longest`` missing values; runs at the ends take the nearest value if ``edges``."""
    w = window(keys, order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(value).isNotNull()
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    a, b = F.max(F.when(known, F.col("_at"))).over(past), F.min(F.when(known, F.col("_at"))).over(future)
    df = df.withColumn("_a", a).withColumn("_b", b).withColumn("_va", F.last(value, True).over(past)).withColumn("_vb", F.first(value, True).over(future))
    run = F.coalesce("_b", F.col("_n") + 1) - F.coalesce("_a", F.lit(0)) - 1
    line = F.col("_va") + (F.col("_vb") - F.col("_va")) * (F.col("_at") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    clamp = F.coalesce("_va", "_vb") if edges else F.lit(None).cast("double")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(run <= longest, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line).otherwise(clamp))
    return df.withColumn(out, filled).drop("_at", "_n", "_a", "_b", "_va", "_vb")


def resample(df: DataFrame, keys: Names, t: str, values: Names, step_ms: float) -> DataFrame:
    """Values interpolated onto the grid t0, t0 + step, ... up to the last time. A value is NULL where its series has
    fewer than two samples, or where the raw samples around the grid time are, by distance, more missing than not.

    Union of grid and samples with ``last`` and ``first`` over the time order: no range join, one shuffle.
    """
    span = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    grid = span.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_t1") - F.col("_t0") + 1e-6) / step_ms).cast("int"))))
    return interpolate_at(df, keys, t, values, grid.select(*keys, (F.col("_t0") + F.col("_k") * F.lit(step_ms)).alias(t), F.col("_k").alias("grid")))


def interpolate_at(df: DataFrame, keys: Names, t: str, values: Names, grid: DataFrame) -> DataFrame:
    """Values at the times of ``grid`` (keys, ``t``, grid: the number of a time): linear between samples, the nearest one beyond them; NULL
    where the raw samples around are, by distance, more missing than not, or a key has fewer than two."""
    raw = df.select(*keys, t, *values, *[F.count(v).over(Window.partitionBy(*keys)).alias(f"_n_{v}") for v in values])
    both = raw.unionByName(grid.select(*keys, t, "grid"), allowMissingColumns=True).withColumns({f"_n_{v}": F.max(f"_n_{v}").over(Window.partitionBy(*keys)) for v in values})
    own = Window.partitionBy(*keys).orderBy(t, F.col("grid").isNotNull())
    back = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("grid").isNotNull())
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    sample = F.col("grid").isNull()
    known = {v: F.when(sample & F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v"))) for v in values}
    state = {v: F.when(sample, F.struct(F.col(t).alias("t"), F.when(F.col(v).isNull(), 1.0).otherwise(0.0).alias("v"))) for v in values}
    for side, w in (("a", own), ("b", back)):  # one sort for all values of a direction
        both = both.withColumns({f"_{name}{side}_{v}": F.last(what[v], True).over(upto(w)) for v in values for name, what in (("v", known), ("m", state))})
    out = []
    for v in values:
        def lerp(a, b):
            line = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])
            return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(line)

        value, missing = lerp(F.col(f"_va_{v}"), F.col(f"_vb_{v}")), lerp(F.col(f"_ma_{v}"), F.col(f"_mb_{v}"))
        out.append(F.when((F.col(f"_n_{v}") >= 2) & (missing <= 0.5), value).alias(v))
    return both.filter(F.col("grid").isNotNull()).select(*keys, "grid", t, *out)


def runs(df: DataFrame, keys: Names, order: Names, condition: Column) -> DataFrame:
    """Half-open runs ``start, end, length`` of consecutive rows where ``condition`` holds (rows counted from 0)."""
    w = window(keys, order)
    flagged = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_ok", F.coalesce(condition, F.lit(False))).filter("_ok")
    flagged = flagged.withColumn("_run", F.col("_at") - F.row_number().over(w))
    return flagged.groupBy(*keys, "_run").agg(F.min("_at").alias("start"), (F.max("_at") + 1).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def longest_run(df: DataFrame, keys: Names, order: Names, condition: Column, least: int) -> DataFrame:
    """The longest run of each key that has at least ``least`` rows; ties to the first."""
    best = F.max_by(F.struct("start", "end", "length"), F.struct("length", -F.col("start")))
    return runs(df, keys, order, condition).filter(F.col("length") >= least).groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def chain_clusters(df: DataFrame, keys: Names, position: str, ties: Names, gap: float, out: str) -> DataFrame:
    """One-dimensional chaining: a value more than ``gap`` after the one before starts the next cluster (from 0)."""
    w = window(keys, [position, *ties])
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w)).drop("_new")


def local_maxima(df: DataFrame, keys: Names, order: Names, value: str, half: int, least: float) -> DataFrame:
    """Rows of at least ``least`` that equal the maximum of ``half`` rows on each side and have as many rows on each side."""
    w = window(keys, order)
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_top", F.max(value).over(w.rowsBetween(-half, half)))
    return df.filter((F.col(value) >= least) & (F.col(value) == F.col("_top")) & (F.col("_at") > half) & (F.col("_at") <= F.col("_n") - half)).drop("_at", "_n", "_top")


def turning_points(df: DataFrame, keys: Names, order: Names, x: str, y: str, least: float) -> DataFrame:
    """Rows where the steps before and after point apart (cosine below 0) and both are longer than ``least``; adds ``cosine``."""
    w = window(keys, order)
    ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    df = df.withColumn("_a", F.sqrt(ax * ax + ay * ay)).withColumn("_b", F.sqrt(bx * bx + by * by)).withColumn("_dot", ax * bx + ay * by)
    df = df.filter((F.col("_a") > least) & (F.col("_b") > least)).withColumn("cosine", F.col("_dot") / (F.col("_a") * F.col("_b")))
    return df.filter("cosine < 0").drop("_a", "_b", "_dot")


def bounce_candidates(df: DataFrame, keys: Names, order: Names, y: str, vy: str, fall: float = 3.0, half: int = 3, share: float = 0.95) -> DataFrame:
    """Rows where a downward velocity turns upward near the lowest picture point around (y grows downward)."""
    w = window(keys, order)
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    df = df.withColumn("vy_before", F.lag(vy).over(w)).withColumn("vy_after", F.lead(vy).over(w)).withColumn("_low", F.max(y).over(w.rowsBetween(-half, half)))
    hit = (F.col("vy_before") > fall) & (F.col("vy_after") < -fall) & (F.col(y) >= share * F.col("_low")) & (F.col("_at") > 2) & (F.col("_at") <= F.col("_n") - 2)
    return df.filter(hit).drop("_at", "_n", "_low")


def expand_frames(df: DataFrame, keys: Names, frame: str, before: int, after: int, step: int = 1) -> DataFrame:
    """Distinct frames from ``before`` before to ``after`` after each row's frame."""
    return df.select(*keys, F.explode(F.sequence(F.col(frame) - before, F.col(frame) + after, F.lit(step))).alias(frame)).distinct()


def gap_groups(df: DataFrame, keys: Names, frame: str, gap: int) -> DataFrame:
    """Groups of frames at most ``gap`` apart, each with its truncated median: ``first, last, n, median``."""
    groups = chain_clusters(df, keys, frame, [], gap, "_group")
    return groups.groupBy(*keys, "_group").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n"), F.median(frame).cast("int").alias("median")).drop("_group")


def parabolic_offset(before: Column, at: Column, after: Column) -> Column:
    """Offset of the vertex of the parabola through three equally spaced values, clipped to half a step; 0 if flat or at an end."""
    bend = before - 2 * at + after
    return F.when(before.isNull() | after.isNull() | (F.abs(bend) < 1e-12), F.lit(0.0)).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend)))


def argmax_refined(df: DataFrame, keys: Names, order: Names, frame: str, value: str, margin: float = 0.0) -> DataFrame:
    """First row of the largest value, without the outer ``margin`` share of rows on each side: ``frame, value, refined``
    (sub-frame position). Keys whose largest value is not positive give no row."""
    w = window(keys, order)
    df = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    cut = F.floor(F.col("_n") * margin)
    df = df.withColumn("_v", F.when((F.col("_at") < cut) | (F.col("_at") >= F.col("_n") - cut), 0.0).otherwise(F.coalesce(value, F.lit(0.0))))
    df = df.withColumn("_off", parabolic_offset(F.lag("_v").over(w), F.col("_v"), F.lead("_v").over(w)))
    best = F.max_by(F.struct(F.col(frame).alias("frame"), F.col("_v").alias("value"), (F.col(frame) + F.col("_off")).alias("refined")), F.struct("_v", -F.col("_at")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*").filter("value > 0")


def prominent_peaks(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Local maxima (a plateau counts at its middle row) with their prominence: height over the higher of the lowest values
    between the peak and the next higher value on each side (or the end)."""
    w = window(keys, order)
    rows = df.withColumn("_at", F.row_number().over(w))
    flat = rows.withColumn("_step", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))).withColumn("_flat", F.sum("_step").over(w))
    flat = flat.groupBy(*keys, "_flat").agg(F.first(value).alias(value), F.min("_at").alias("a"), F.max("_at").alias("b"))
    f = window(keys, ["_flat"])
    tops = flat.filter(F.col(value).isNotNull()).withColumn("_l", F.lag(value).over(f)).withColumn("_r", F.lead(value).over(f))
    tops = tops.filter((F.col("_l") < F.col(value)) & (F.col("_r") < F.col(value))).select(*keys, F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("at"), F.col(value).alias("height"))
    # values beyond a higher one do not matter: the range to it is found by a join on the keys, the lowest by an aggregate
    other = rows.select(*keys, "_at", F.col(value).alias("_v"))
    sides = tops.join(other, keys)
    limits = sides.groupBy(*keys, "at", "height").agg(F.max(F.when((F.col("_at") < F.col("at")) & (F.col("_v") > F.col("height")), F.col("_at"))).alias("lo"), F.min(F.when((F.col("_at") > F.col("at")) & (F.col("_v") > F.col("height")), F.col("_at"))).alias("hi"))
    sides = limits.join(other, keys).filter((F.col("_at") > F.coalesce("lo", F.lit(0))) & (F.col("_at") < F.coalesce("hi", F.lit(2**31 - 1))))
    low = sides.groupBy(*keys, "at", "height").agg(F.min(F.when(F.col("_at") <= F.col("at"), F.col("_v"))).alias("left"), F.min(F.when(F.col("_at") >= F.col("at"), F.col("_v"))).alias("right"))
    return low.select(*keys, (F.col("at") - 1).alias("at"), "height", (F.col("height") - F.greatest("left", "right")).alias("prominence"))
