"""Registered queries of the time-series operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold, series
from ..sources.adapters import duck, view

CLIP, FRAME = ["clip_id"], ["frame"]


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def sig(spark, d):
    return view(spark, d, "sig")


def filled(spark, d, longest=2):
    return series.fill_gaps(sig(spark, d), CLIP, FRAME, "x", longest, "f")


def wn1_gradient(spark, d):
    df = series.gradient(sig(spark, d), CLIP, FRAME, "x", "t_ms", "v")
    return df.select("clip_id", "frame", (F.round(F.col("v") * 1000, 6) + F.lit(0.0)).alias("v"))


def wn1_speed(spark, d):
    p = view(spark, d, "pose").filter("lm_id in (15, 16)")
    return r6(series.speed(p.withColumn("s", F.col("t_ms") / 1000), ["clip_id", "lm_id"], FRAME, ["x", "y", "z"], "s", "v").select("clip_id", "lm_id", "frame", "v"), "v")


def wn2_acceleration(spark, d):
    df = view(spark, d, "pose").filter("lm_id = 16").withColumn("s", F.col("t_ms") / 1000)
    df = series.gradient(series.gradient(df, CLIP, FRAME, "x", "s", "v"), CLIP, FRAME, "v", "s", "a")
    return r6(df.select("clip_id", "frame", F.abs("a").alias("a")), "a")


def wn3_wrist_speed(spark, d):
    df = series.neighbour_speed(view(spark, d, "pose").filter("lm_id in (15, 16)"), ["clip_id", "lm_id"], FRAME, "x", "y", "vis", 0.5, "v")
    return r6(df.select("clip_id", "lm_id", "frame", "v"), "v")


def wn4_vertical_velocity(spark, d):
    df = series.moving_average(sig(spark, d), CLIP, FRAME, "x", 2, "m")
    w = series.window(CLIP, FRAME)
    return r6(df.select("clip_id", "frame", ((F.lead("m").over(w) - F.lag("m").over(w)) / 2).alias("vy")), "vy")


def wn5_moving_average(spark, d):
    return r6(series.moving_average(sig(spark, d), CLIP, FRAME, "x", 2, "m").select("clip_id", "frame", "m"), "m")


def wn6_savgol(spark, d):
    return r6(series.savgol(filled(spark, d, 5), CLIP, FRAME, "f", "s", 7).select("clip_id", "frame", "s"), "s")


def wn7_savgol_energy(spark, d):
    e = series.speed(view(spark, d, "pose").withColumn("s", F.col("t_ms") / 1000), ["clip_id", "lm_id"], FRAME, ["x", "y"], "s", "v")
    e = e.filter("lm_id between 11 and 16").groupBy("clip_id", "frame").agg(F.sum("v").alias("energy"))
    return r6(series.savgol(e, CLIP, FRAME, "energy", "s", 11).select("clip_id", "frame", "s"), "s")


def wn9_fill_short_gaps(spark, d):
    return r6(filled(spark, d).select("clip_id", "frame", "f"), "f")


def wn10_fill_interior_gaps(spark, d):
    return r6(series.fill_gaps(sig(spark, d), CLIP, FRAME, "x", 3, "f", edges=False).select("clip_id", "frame", "f"), "f")


def wn11_dense_boxes(spark, d):
    b = view(spark, d, "boxes").groupBy("clip_id", "track_id", "frame").agg(F.avg("x").alias("x"))
    spine = b.groupBy("clip_id", "track_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("clip_id", "track_id", F.explode(F.sequence("a", "b")).alias("frame"))
    df = series.fill_gaps(spine.join(b, ["clip_id", "track_id", "frame"], "left"), ["clip_id", "track_id"], FRAME, "x", 1 << 30, "f")
    return r6(df.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("f").alias("sum_x"), F.min("f").alias("min_x"), F.max("f").alias("max_x")), "sum_x", "min_x", "max_x")


def wn12_resample(spark, d):
    df = series.resample(sig(spark, d), CLIP, "t_ms", ["x"], 3_600_000.0 * 24)
    return r6(df.select("clip_id", "grid", "x"), "x")


def wn13_low_visibility_runs(spark, d):
    p = view(spark, d, "pose").filter("lm_id in (13, 14, 15, 16)")
    return series.runs(p, ["clip_id", "lm_id"], FRAME, F.col("vis") < 0.5).withColumns({c: F.col(c).cast("long") for c in ("start", "end", "length")})


def wn15_local_maxima(spark, d):
    return r6(series.local_maxima(filled(spark, d, 100), CLIP, FRAME, "f", 3, 40.0).select("clip_id", "frame", "f"), "f")


def wn16_merge_peaks(spark, d):
    peaks = series.local_maxima(filled(spark, d, 100), CLIP, FRAME, "f", 1, 20.0)
    return r6(fold.merge_peaks(peaks.select("clip_id", "frame", "f"), CLIP, "frame", "f", 6), "f")


def _points(spark, d):
    return view(spark, d, "boxes").filter("class = 'ball'").groupBy("clip_id", "frame").agg(F.min_by("x", "box_key").alias("x"), F.min_by("y", "box_key").alias("y"))


def wn17_turning_points(spark, d):
    return r6(series.turning_points(_points(spark, d), CLIP, FRAME, "x", "y", 1.5).select("clip_id", "frame", "cosine"), "cosine")


def wn18_expand_frames(spark, d):
    t = series.turning_points(_points(spark, d), CLIP, FRAME, "x", "y", 1.5)
    return series.expand_frames(t, CLIP, "frame", 3, 3).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("sum_frame"))


def wn19_gap_groups(spark, d):
    return series.gap_groups(_points(spark, d), CLIP, "frame", 2)


def wn20_bounce_candidates(spark, d):
    p = series.moving_average(_points(spark, d), CLIP, FRAME, "y", 1, "m")
    w = series.window(CLIP, FRAME)
    p = p.withColumn("vy", (F.lead("m").over(w) - F.lag("m").over(w)) / 2)
    return r6(series.bounce_candidates(p, CLIP, FRAME, "m", "vy").select("clip_id", "frame", "vy_before", "vy_after"), "vy_before", "vy_after")


def wn21_bounce_dedup(spark, d):
    return fold.fold_kept(wn20_bounce_candidates(spark, d), CLIP, ["frame"], "frame", 10, lambda new, kept: new["vy_before"] > kept["vy_before"], ["frame", "vy_before"])


def wn22_hit_dedup(spark, d):
    s = sig(spark, d).filter("x is not null").withColumn("rank", (F.col("x") / 30).cast("int")).select("clip_id", "frame", "x", "rank")
    better = lambda new, kept: (new["rank"] > kept["rank"]) | ((new["rank"] == kept["rank"]) & (new["x"] > kept["x"]))
    return r6(fold.fold_kept(s, CLIP, ["frame"], "frame", 4, better, ["frame", "rank", "x"]), "x")


def wn23_prominent_peaks(spark, d):
    s = series.moving_average(sig(spark, d), CLIP, FRAME, "x", 2, "m").filter("m is not null")
    return r6(series.prominent_peaks(s, CLIP, FRAME, "m"), "height", "prominence")


def wn25_impact(spark, d):
    e = series.speed(view(spark, d, "pose").withColumn("s", F.col("t_ms") / 1000), ["clip_id", "lm_id"], FRAME, ["x", "y"], "s", "v").filter("lm_id in (15, 16)")
    return r6(series.argmax_refined(e, ["clip_id", "lm_id"], FRAME, "frame", "v", 0.15), "value", "refined")


def wn36_longest_run(spark, d):
    return series.longest_run(sig(spark, d), CLIP, FRAME, F.col("x") > 30, 2).withColumns({c: F.col(c).cast("long") for c in ("start", "end", "length")})


def wn37_chain_clusters(spark, d):
    c = series.chain_clusters(view(spark, d, "segs"), FRAME, "y1", ["seg_id"], 5.0, "cluster")
    return c.groupBy("frame", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("y1").alias("low"), F.max("y1").alias("high"))


def wn38_trail(spark, d):
    w = series.window(CLIP, FRAME).rowsBetween(-14, 0)
    t = sig(spark, d).withColumn("trail", F.collect_list("frame").over(w))
    return t.select("clip_id", "frame", F.size("trail").cast("long").alias("n"), F.element_at("trail", 1).alias("oldest"))


def st1_one_euro(spark, d):
    s = sig(spark, d).withColumn("t_s", F.col("t_ms") / 3_600_000.0)
    return r6(fold.one_euro(s, CLIP, "frame", "t_s", "x", None), "smooth")


QUERIES = {f.__name__: f for f in (wn1_gradient, wn1_speed, wn2_acceleration, wn3_wrist_speed, wn4_vertical_velocity, wn5_moving_average, wn6_savgol, wn7_savgol_energy, wn9_fill_short_gaps, wn10_fill_interior_gaps, wn11_dense_boxes, wn12_resample, wn13_low_visibility_runs, wn15_local_maxima, wn16_merge_peaks, wn17_turning_points, wn18_expand_frames, wn19_gap_groups, wn20_bounce_candidates, wn21_bounce_dedup, wn22_hit_dedup, wn23_prominent_peaks, wn25_impact, wn36_longest_run, wn37_chain_clusters, wn38_trail, st1_one_euro)}

_W = "partition by clip_id order by frame"
_GRAD = "(coalesce(lead({x}) over w, case when rn = n then {x} end) - coalesce(lag({x}) over w, case when rn = 1 then {x} end)) / (coalesce(lead({t}) over w, {t}) - coalesce(lag({t}) over w, {t}))"


def _filled(longest: int, edges: bool = True, src: str = "sig", x: str = "x", keys: str = "clip_id") -> str:
    clamp = "coalesce(va, vb)" if edges else "null"
    return f"""
  select *, case when {x} is not null then {x} when coalesce(b, n + 1) - coalesce(a, 0) - 1 <= {longest}
              then case when a is not null and b is not null then va + (vb - va) * (rn - a) / (b - a) else {clamp} end end as f
  from (select *, max(case when {x} is not null then rn end) over (partition by {keys} order by frame rows unbounded preceding) as a,
               min(case when {x} is not null then rn end) over (partition by {keys} order by frame rows between current row and unbounded following) as b,
               last_value({x} ignore nulls) over (partition by {keys} order by frame rows unbounded preceding) as va,
               first_value({x} ignore nulls) over (partition by {keys} order by frame rows between current row and unbounded following) as vb
        from (select *, row_number() over (partition by {keys} order by frame) as rn, count(*) over (partition by {keys}) as n from {src}))"""


def _numbered(src: str, keys: str = "clip_id") -> str:
    return f"(select *, row_number() over (partition by {keys} order by frame) as rn, count(*) over (partition by {keys}) as n from {src})"


_SG7 = {0: [32, 15, 3, -4, -6, -3, 5], 1: [15, 12, 9, 6, 3, 0, -3], 2: [3, 9, 12, 12, 9, 3, -6], 3: [-4, 6, 12, 14, 12, 6, -4]}
_SG7 = {k: [v / 42 for v in w] for k, w in _SG7.items()}


def _savgol_sql(weights: dict, size: int, x: str, keys: str, src: str) -> str:
    half, parts = size // 2, []
    term = lambda off: f"lag({x}, {-off}) over w" if off < 0 else f"lead({x}, {off}) over w" if off > 0 else x
    for p in range(half):
        parts.append(f"when rn = {p + 1} then " + " + ".join(f"({c!r}::DOUBLE) * {term(i - p)}" for i, c in enumerate(weights[p])))
        parts.append(f"when rn = n - {p} then " + " + ".join(f"({c!r}::DOUBLE) * {term(p - i)}" for i, c in enumerate(weights[p])))
    middle = " + ".join(f"({c!r}::DOUBLE) * {term(i - half)}" for i, c in enumerate(weights[half]))
    return f"""select *, case when count({x}) over (partition by {keys}) < n or n < 5 then {x} {" ".join(parts)} else {middle} end as s
      from {_numbered(src, keys)} window w as (partition by {keys} order by frame)"""


_SEVEN = _SG7
_WEIGHTS11 = {i: w for i, w in enumerate(series.savgol_weights(11)[:6])}
_POINTS = "p as (select clip_id, frame, min_by(x, box_key) as x, min_by(y, box_key) as y from boxes where class = 'ball' group by clip_id, frame)"
_ENERGY = f"g as (select *, {_GRAD.format(x='x', t='(t_ms / 1000)')} as vx, {_GRAD.format(x='y', t='(t_ms / 1000)')} as vy, {_GRAD.format(x='z', t='(t_ms / 1000)')} as vz from {_numbered('pose', 'clip_id, lm_id')} window w as (partition by clip_id, lm_id order by frame))"
_TURN = """t as (
  select * from (select *, sqrt(ax * ax + ay * ay) as la, sqrt(bx * bx + by_ * by_) as lb, ax * bx + ay * by_ as dot
    from (select *, x - lag(x) over w as ax, y - lag(y) over w as ay, lead(x) over w - x as bx, lead(y) over w - y as by_ from p window w as (partition by clip_id order by frame)))
  where la > 1.5 and lb > 1.5 and dot / (la * lb) < 0)"""
_BOUNCE = """m as (select *, avg(y) over (partition by clip_id order by frame rows between 1 preceding and 1 following) as m from p),
v as (select *, (lead(m) over w - lag(m) over w) / 2 as vy, row_number() over w as rn, count(*) over (partition by clip_id) as n, max(m) over (partition by clip_id order by frame rows between 3 preceding and 3 following) as low from m window w as (partition by clip_id order by frame)),
c as (select clip_id, frame, round(lag(vy) over w, 6) as vy_before, round(lead(vy) over w, 6) as vy_after, m, low, rn, n, lag(vy) over w as b0, lead(vy) over w as a0 from v window w as (partition by clip_id order by frame)),
bounces as (select clip_id, frame, vy_before, vy_after from c where b0 > 3 and a0 < -3 and m >= 0.95::DOUBLE * low and rn > 2 and rn <= n - 2)"""


def _fold_sql(src: str, gap: int, better: str, cols: list[str]) -> str:
    """Keep-last-kept by recursion over row numbers: ``kept_*`` is the state after a row, ``fresh`` whether a new event began."""
    state = ", ".join(f"{c} as kept_{c}" for c in cols)
    pick = ", ".join(f"case when e.frame - k.kept_frame >= {gap} or ({better}) then e.{c} else k.kept_{c} end" for c in cols)
    return f"""numbered as (select *, row_number() over (partition by clip_id order by frame) as i from {src}),
walk as (
  select clip_id, i, {state}, 1 as event from numbered where i = 1
  union all
  select e.clip_id, e.i, {pick}, k.event + case when e.frame - k.kept_frame >= {gap} then 1 else 0 end
  from walk k join numbered e on e.clip_id = k.clip_id and e.i = k.i + 1
), kept as (select clip_id, event, {", ".join(f"max_by(kept_{c}, i) as {c}" for c in cols)} from walk group by clip_id, event)"""


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


ORACLE_SQL = {
    "wn1_gradient": f"{duck('sig')} select clip_id, frame, round(({_GRAD.format(x='x', t='t_ms')}) * 1000, 6) + 0::DOUBLE as v from {_numbered('sig')} window w as ({_W})",
    "wn1_speed": f"{duck('pose')}, {_ENERGY} select clip_id, lm_id, frame, round(sqrt(vx * vx + vy * vy + vz * vz), 6) as v from g where lm_id in (15, 16)",
    "wn2_acceleration": f"{duck('pose')}, {_ENERGY} select clip_id, frame, round(abs({_GRAD.format(x='vx', t='(t_ms / 1000)')}), 6) as a from (select * from g where lm_id = 16) window w as ({_W})",
    "wn3_wrist_speed": f"{duck('pose')} select clip_id, lm_id, frame, round(case when lead(vis) over w > 0.5 and lag(vis) over w > 0.5 then sqrt((lead(x) over w - lag(x) over w) ** 2 + (lead(y) over w - lag(y) over w) ** 2) / 2 end, 6) as v from pose where lm_id in (15, 16) window w as (partition by clip_id, lm_id order by frame)",
    "wn4_vertical_velocity": f"{duck('sig')}, m as (select *, avg(x) over ({_W} rows between 2 preceding and 2 following) as m from sig) select clip_id, frame, round((lead(m) over w - lag(m) over w) / 2, 6) as vy from m window w as ({_W})",
    "wn5_moving_average": f"{duck('sig')} select clip_id, frame, round(avg(x) over ({_W} rows between 2 preceding and 2 following), 6) as m from sig",
    "wn6_savgol": f"{duck('sig')}, f as ({_filled(5)}) select clip_id, frame, round(s, 6) as s from ({_savgol_sql(_SEVEN, 7, 'f', 'clip_id', '(select clip_id, frame, f from f)')})",
    "wn7_savgol_energy": f"{duck('pose')}, {_ENERGY}, e as (select clip_id, frame, sum(sqrt(vx * vx + vy * vy)) as energy from g where lm_id between 11 and 16 group by clip_id, frame) select clip_id, frame, round(s, 6) as s from ({_savgol_sql(_WEIGHTS11, 11, 'energy', 'clip_id', 'e')})",
    "wn9_fill_short_gaps": f"{duck('sig')} select clip_id, frame, round(f, 6) as f from ({_filled(2)})",
    "wn10_fill_interior_gaps": f"{duck('sig')} select clip_id, frame, round(f, 6) as f from ({_filled(3, False)})",
    "wn11_dense_boxes": f"""{duck('boxes')}, b as (select clip_id, track_id, frame, avg(x) as x from boxes group by all),
spine as (select clip_id, track_id, unnest(generate_series(min(frame), max(frame))) as frame from b group by clip_id, track_id),
d as (select s.clip_id, s.track_id, s.frame, b.x from spine s left join b using (clip_id, track_id, frame))
select clip_id, track_id, count(*) as frames, round(sum(f), 6) as sum_x, round(min(f), 6) as min_x, round(max(f), 6) as max_x from ({_filled(1 << 30, True, 'd', 'x', 'clip_id, track_id')}) group by clip_id, track_id""",
    "wn12_resample": f"""{duck('sig')}, span as (select clip_id, min(t_ms) as t0, max(t_ms) as t1, count(x) as known from sig group by clip_id),
grid as (select clip_id, t0, known, unnest(generate_series(0, floor((t1 - t0) / 86400000)::BIGINT)) as grid from span),
g as (select clip_id, grid, known, t0 + grid * 86400000::DOUBLE as t from grid),
va as (select g.clip_id, g.grid, max_by(struct_pack(t := s.t_ms, v := s.x), s.t_ms) as p from g join sig s on g.clip_id = s.clip_id and s.t_ms <= g.t and s.x is not null group by all),
vb as (select g.clip_id, g.grid, min_by(struct_pack(t := s.t_ms, v := s.x), s.t_ms) as p from g join sig s on g.clip_id = s.clip_id and s.t_ms >= g.t and s.x is not null group by all),
ma as (select g.clip_id, g.grid, max_by(struct_pack(t := s.t_ms, v := case when s.x is null then 1::DOUBLE else 0 end), s.t_ms) as p from g join sig s on g.clip_id = s.clip_id and s.t_ms <= g.t group by all),
mb as (select g.clip_id, g.grid, min_by(struct_pack(t := s.t_ms, v := case when s.x is null then 1::DOUBLE else 0 end), s.t_ms) as p from g join sig s on g.clip_id = s.clip_id and s.t_ms >= g.t group by all),
j as (select g.*, va.p as va, vb.p as vb, ma.p as ma, mb.p as mb from g left join va using (clip_id, grid) left join vb using (clip_id, grid) left join ma using (clip_id, grid) left join mb using (clip_id, grid))
select clip_id, grid::INTEGER as grid, round(case when known >= 2 and case when ma is null then mb.v when mb is null or ma.t = mb.t then ma.v else ma.v + (mb.v - ma.v) * (t - ma.t) / (mb.t - ma.t) end <= 0.5
  then case when va is null then vb.v when vb is null or va.t = vb.t then va.v else va.v + (vb.v - va.v) * (t - va.t) / (vb.t - va.t) end end, 6) as x from j""",
    "wn13_low_visibility_runs": f"""{duck('pose')}, q as (select *, row_number() over (partition by clip_id, lm_id order by frame) - 1 as i from pose where lm_id in (13, 14, 15, 16)),
r as (select *, i - row_number() over (partition by clip_id, lm_id order by frame) as run from q where vis < 0.5)
select clip_id, lm_id, min(i) as start, max(i) + 1 as "end", count(*) as length from r group by clip_id, lm_id, run""",
    "wn15_local_maxima": f"{duck('sig')}, f as ({_filled(100)}) select clip_id, frame, round(f, 6) as f from (select *, max(f) over ({_W} rows between 3 preceding and 3 following) as top from f) where f >= 40 and f = top and rn > 3 and rn <= n - 3",
    "wn16_merge_peaks": _recursive(f"{duck('sig')}, filled as ({_filled(100)}), peaks as (select clip_id, frame, f from (select *, max(f) over ({_W} rows between 1 preceding and 1 following) as top from filled) where f >= 20 and f = top and rn > 1 and rn <= n - 1), {_fold_sql('peaks', 6, 'e.f > k.kept_f', ['frame', 'f'])} select clip_id, frame, round(f, 6) as f from kept"),
    "wn17_turning_points": f"{duck('boxes')}, {_POINTS}, {_TURN} select clip_id, frame, round(dot / (la * lb), 6) as cosine from t",
    "wn18_expand_frames": f"{duck('boxes')}, {_POINTS}, {_TURN} select clip_id, count(*) as n, sum(frame)::BIGINT as sum_frame from (select distinct clip_id, unnest(generate_series(frame - 3, frame + 3)) as frame from t) group by clip_id",
    "wn19_gap_groups": f"{duck('boxes')}, {_POINTS}, g as (select *, sum(coalesce((frame - last > 2)::INT, 0)) over ({_W}) as grp from (select *, lag(frame) over ({_W}) as last from p)) select clip_id, min(frame) as first, max(frame) as last, count(*) as n, trunc(median(frame))::INTEGER as median from g group by clip_id, grp",
    "wn20_bounce_candidates": f"{duck('boxes')}, {_POINTS}, {_BOUNCE} select * from bounces",
    "wn21_bounce_dedup": _recursive(f"{duck('boxes')}, {_POINTS}, {_BOUNCE}, {_fold_sql('bounces', 10, 'e.vy_before > k.kept_vy_before', ['frame', 'vy_before'])} select clip_id, frame, vy_before from kept"),
    "wn22_hit_dedup": _recursive(f"{duck('sig')}, s as (select clip_id, frame, x, trunc(x / 30)::INTEGER as rank from sig where x is not null), {_fold_sql('s', 4, 'e.rank > k.kept_rank or (e.rank = k.kept_rank and e.x > k.kept_x)', ['frame', 'rank', 'x'])} select clip_id, frame, rank, round(x, 6) as x from kept"),
    "wn23_prominent_peaks": f"""{duck('sig')}, m as (select clip_id, m, row_number() over ({_W}) as i from (select *, avg(x) over ({_W} rows between 2 preceding and 2 following) as m from sig) where m is not null),
q as (select *, sum(coalesce((m <> last)::INT, 1)) over (partition by clip_id order by i) as flat from (select *, lag(m) over (partition by clip_id order by i) as last from m)),
flats as (select clip_id, flat, min(m) as m, min(i) as a, max(i) as b from q group by clip_id, flat),
tops as (select clip_id, (a + b) // 2 as at, m as height from (select *, lag(m) over w as l, lead(m) over w as r from flats window w as (partition by clip_id order by flat)) where l < m and r < m),
lim as (select t.clip_id, t.at, t.height, max(case when o.i < t.at and o.m > t.height then o.i end) as lo, min(case when o.i > t.at and o.m > t.height then o.i end) as hi from tops t join m o on t.clip_id = o.clip_id group by all)
select l.clip_id, (l.at - 1)::INTEGER as at, round(l.height, 6) as height, round(l.height - greatest(min(case when o.i <= l.at then o.m end), min(case when o.i >= l.at then o.m end)), 6) as prominence
from lim l join m o on l.clip_id = o.clip_id and o.i > coalesce(l.lo, 0) and o.i < coalesce(l.hi, 2147483647) group by l.clip_id, l.at, l.height""",
    "wn25_impact": f"""{duck('pose')}, {_ENERGY}, e as (select clip_id, lm_id, frame, rn - 1 as i, n, sqrt(vx * vx + vy * vy) as v from g where lm_id in (15, 16)),
z as (select *, case when i < floor(n * 0.15::DOUBLE) or i >= n - floor(n * 0.15::DOUBLE) then 0 else v end as c from e),
o as (select *, lag(c) over w as l, lead(c) over w as r from z window w as (partition by clip_id, lm_id order by frame)),
b as (select *, row_number() over (partition by clip_id, lm_id order by c desc, i) as k from o)
select clip_id, lm_id, frame, round(c, 6) as value, round(frame + case when l is null or r is null or abs(l - 2 * c + r) < 1e-12 then 0 else greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (l - r) / (l - 2 * c + r))) end, 6) as refined from b where k = 1 and c > 0""",
    "wn36_longest_run": f"""{duck('sig')}, q as (select *, row_number() over ({_W}) - 1 as i from sig), r as (select *, i - row_number() over ({_W}) as run from q where x > 30),
s as (select clip_id, min(i) as start, max(i) + 1 as "end", count(*) as length from r group by clip_id, run)
select clip_id, start, "end", length from (select *, row_number() over (partition by clip_id order by length desc, start) as k from s where length >= 2) where k = 1""",
    "wn37_chain_clusters": f"""{duck('segs')}, c as (select *, sum(coalesce((y1 - last > 5)::INT, 0)) over (partition by frame order by y1, seg_id) as cluster from (select *, lag(y1) over (partition by frame order by y1, seg_id) as last from segs))
select frame, cluster::BIGINT as cluster, count(*) as n, min(y1) as low, max(y1) as high from c group by frame, cluster""",
    "wn38_trail": f"{duck('sig')} select clip_id, frame, count(*) over w as n, min(frame) over w as oldest from sig window w as ({_W} rows between 14 preceding and current row)",
    "st1_one_euro": _recursive(f"""{duck('sig')}, s as (select clip_id, frame, t_ms / 3600000 as t, x as v from sig),
walk as (
  select clip_id, frame, case when v is null then null else t end as t, v as x, 0::DOUBLE as dx from s where frame = 0
  union all
  select e.clip_id, e.frame, case when e.v is null then k.t else e.t end,
    case when k.x is null then e.v when e.v is null then k.x else e.a * e.v + (1 - e.a) * k.x end,
    case when k.x is null or e.v is null then k.dx else e.d end
  from walk k join lateral (
    select q.*, 1 / (1 + 1 / (6.283185307179586::DOUBLE * (1 + 0.3::DOUBLE * abs(q.d)) * q.dt)) as a from (
      select s.*, greatest(s.t - k.t, 1e-6::DOUBLE) as dt, (1 / (1 + 1 / (6.283185307179586::DOUBLE * greatest(s.t - k.t, 1e-6::DOUBLE)))) * (s.v - k.x) / greatest(s.t - k.t, 1e-6::DOUBLE) + (1 - 1 / (1 + 1 / (6.283185307179586::DOUBLE * greatest(s.t - k.t, 1e-6::DOUBLE)))) * k.dx as d
      from s where s.clip_id = k.clip_id and s.frame = k.frame + 1) q) e on true
) select clip_id, frame::BIGINT as frame, round(x, 6) as smooth from walk"""),
}
