"""Per-clip pose operators: wide frames, keyframes, calibration, quality, classification and stroke metrics.

``pose`` tables are long (clip_id, frame, t_ms, lm_id, x, y, z, vis). ``wide`` deals them by clip and turns the landmarks in
use into one row per frame with one pruned struct column each. ``tracked`` adds the keyframes as columns by windows over
that dealing, and types, quality, confidence and metrics are grouped aggregates by clip over it: nothing is joined to its own
aggregates and nothing is dealt again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import body as B
from . import series

CLIP, ORDER = ["clip_id"], ["frame"]
USED = (B.NOSE, B.L_EAR, B.R_EAR, *B.UPPER, B.L_INDEX, B.R_INDEX, B.L_HIP, B.R_HIP, B.L_KNEE, B.R_KNEE, B.L_ANKLE, B.R_ANKLE)
# Limits of the rules below.
ASPECT = 960 / 540
DEVIATION_DEGRADED, DEVIATION_REJECT, ROLL_FLAG, ROLL_LEAST = 15.0, 30.0, 8.0, 0.5
OVERHEAD_MARGIN, COMPACT_AMPLITUDE, SLICE_PATH = 0.03, 0.35, -15.0
EDGE_MARGIN, JUMP_RATIO, READY_TOLERANCE = 0.04, 0.08, 0.12
KEYFRAMES = ("unit_turn", "backswing_peak", "impact", "follow_through_peak", "ready_restored")


def at(lm: int, axis: str) -> Column:
    return F.col(f"p{lm}.{axis}")


def mid(a: int, b: int, axis: str) -> Column:
    return (at(a, axis) + at(b, axis)) / 2


def wide(pose: DataFrame, used=USED) -> DataFrame:
    """One row per clip and frame, dealt by clip: ``p<landmark>`` structs of x, y, z, vis, and ``vis_max`` over all landmarks."""
    picks = [F.first(F.when(F.col("lm_id") == i, F.struct("x", "y", "z", "vis")), True).alias(f"p{i}") for i in used]
    dealt = pose.select("clip_id", "frame", "t_ms", "lm_id", "x", "y", "z", "vis").repartition("clip_id")
    return dealt.groupBy("clip_id", "frame").agg(F.first("t_ms").alias("t_ms"), F.max("vis").alias("vis_max"), *picks)


def handed(frames: DataFrame, hand: str = "R") -> dict[str, int]:
    """Landmarks of the playing side."""
    return {"wrist": B.R_WRIST, "elbow": B.R_ELBOW, "shoulder": B.R_SHOULDER, "hip": B.R_HIP, "ear": B.R_EAR, "index": B.R_INDEX} if hand == "R" else {"wrist": B.L_WRIST, "elbow": B.L_ELBOW, "shoulder": B.L_SHOULDER, "hip": B.L_HIP, "ear": B.L_EAR, "index": B.L_INDEX}


def core_visibility(landmarks=B.CORE) -> Column:
    return sum((at(i, "vis") for i in landmarks[1:]), at(landmarks[0], "vis")) / len(landmarks)


def centre_of_mass(axis: str) -> Column:
    """The trunk's middle and the middles of the limbs' segments, weighted by mass."""
    trunk = (mid(11, 12, axis) + mid(23, 24, axis)) / 2 * B.TRUNK_MASS
    return sum((mid(a, b, axis) * m for a, b, m in B.SEGMENTS), trunk)


def body_height(over: Window) -> Column:
    """Ankle to shoulder in the picture, of the medians over a clip."""
    return F.abs(F.median(mid(27, 28, "y")).over(over) - F.median(mid(11, 12, "y")).over(over)) + F.lit(1e-9)


def motion_energy(frames: DataFrame) -> DataFrame:
    """Adds ``energy``: summed speed of shoulders, elbows and wrists."""
    t = frames.withColumn("_s", F.col("t_ms") / 1000)
    for i in B.UPPER:
        t = t.withColumn("_x", F.coalesce(at(i, "x"), F.lit(0.0))).withColumn("_y", F.coalesce(at(i, "y"), F.lit(0.0)))
        t = series.speed(t, CLIP, ORDER, ["_x", "_y"], "_s", f"_v{i}")
    return t.withColumn("energy", sum((F.col(f"_v{i}") for i in B.UPPER[1:]), F.col(f"_v{B.UPPER[0]}"))).drop("_s", "_x", "_y", *[f"_v{i}" for i in B.UPPER])


def rotation_proxy(frames: DataFrame) -> DataFrame:
    """Adds ``rot``: 1 less shoulder over hip width in relation to its 90th percentile, within 0 and 1."""
    r = frames.withColumn("_r", F.abs(at(12, "x") - at(11, "x")) / (F.abs(at(24, "x") - at(23, "x")) + F.lit(1e-9)))
    p90 = F.percentile("_r", 0.9).over(Window.partitionBy(*CLIP))
    return r.withColumn("rot", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_r") / (p90 + F.lit(1e-9))))).drop("_r")


def ready_frames(frames: DataFrame) -> DataFrame:
    """Frames of the first half whose energy is at most its 30th percentile there; the first five where none is."""
    clip = Window.partitionBy(*CLIP)
    e = motion_energy(frames).withColumn("_n", F.count(F.lit(1)).over(clip)).withColumn("_at", F.row_number().over(series.window(CLIP, ORDER)))
    half = e.filter(F.col("_at") <= F.floor(F.col("_n") / 2)).withColumn("_p", F.percentile("energy", 0.3).over(clip))
    return half.filter((F.col("energy") <= F.col("_p")) | (F.col("_p").isNull() & (F.col("_at") <= 5))).drop("_n", "_at", "_p")


def _trunk(aspect: float) -> Column:
    return B.norm((mid(11, 12, "x") - mid(23, 24, "x")) * aspect, mid(11, 12, "y") - mid(23, 24, "y"))


def calibration(frames: DataFrame, aspect: float = ASPECT) -> DataFrame:
    """Per clip: medians of shoulder and hip rotation in the ready frames (zero references), roll (median of ankle line and
    trunk axis, in picture proportions), camera deviation, trunk length, the clip's ankle to head height, the tier
    (ok, degraded over 15, reject over 30 degrees of deviation) and the issues that follow."""
    tall = (F.abs(F.median(mid(27, 28, "y")).over(Window.partitionBy(*CLIP)) - F.median(at(0, "y")).over(Window.partitionBy(*CLIP))) + F.lit(1e-9)).alias("_tall")
    ready = ready_frames(frames.select("*", tall))
    sh = B.rotation_deg(at(12, "x") - at(11, "x"), at(12, "z") - at(11, "z"))
    hp = B.rotation_deg(at(24, "x") - at(23, "x"), at(24, "z") - at(23, "z"))
    ankles = F.degrees(F.atan2(at(28, "y") - at(27, "y"), (at(28, "x") - at(27, "x")) * aspect + F.lit(1e-9)))
    axis = F.degrees(F.atan2((mid(11, 12, "x") - mid(23, 24, "x")) * aspect, mid(23, 24, "y") - mid(11, 12, "y") + F.lit(1e-9)))
    base = ready.withColumn("_roll", F.array(ankles, axis)).groupBy(*CLIP).agg(
        F.median(sh).alias("shoulder_zero"), F.median(hp).alias("hip_zero"), (F.median(_trunk(aspect)) + F.lit(1e-9)).alias("trunk"), F.first("_tall").alias("height"), F.count(F.lit(1)).alias("ready_frames"),
        F.array_sort(F.filter(F.flatten(F.collect_list("_roll")), lambda x: x.isNotNull())).alias("_rolls"),
    )
    n = F.size("_rolls")
    middle = (F.col("_rolls")[F.floor((n - 1) / 2).cast("int")] + F.col("_rolls")[F.floor(n / 2).cast("int")]) / 2
    out = base.withColumn("roll_deg", F.when(n > 0, middle)).withColumn("deviation_deg", F.abs("shoulder_zero")).drop("_rolls")
    out = out.withColumn("tier", F.when(F.col("deviation_deg") > DEVIATION_REJECT, "reject").when(F.col("deviation_deg") > DEVIATION_DEGRADED, "degraded").otherwise("ok"))
    issues = F.array_compact(F.array(F.when(F.col("tier") == "reject", "side_view"), F.when(F.abs("roll_deg") > ROLL_FLAG, "camera_tilted")))
    return out.withColumn("issues", F.array_join(issues, ";"))


def roll_corrected(frames: DataFrame, cal: DataFrame, aspect: float = ASPECT, used=USED) -> DataFrame:
    """Landmarks turned back by the clip's roll, from 0.5 degrees on, about the middle of shoulders and hips."""
    f = frames.join(cal.select(*CLIP, F.coalesce(F.when(F.abs("roll_deg") >= ROLL_LEAST, F.col("roll_deg")), F.lit(0.0)).alias("_roll")), CLIP)
    middle = lambda a: sum((at(i, a) for i in B.TRUNK[1:]), at(B.TRUNK[0], a)) / len(B.TRUNK)
    f = f.withColumn("_cx", middle("x")).withColumn("_cy", middle("y"))
    turned = {}
    for i in used:
        x, y = B.rotate(at(i, "x") * aspect, at(i, "y"), F.col("_cx") * aspect, F.col("_cy"), -F.col("_roll"))
        turned[f"p{i}"] = F.when(F.col("_roll") == 0, F.col(f"p{i}")).otherwise(F.struct((x / aspect).alias("x"), y.alias("y"), at(i, "z").alias("z"), at(i, "vis").alias("vis")))
    return f.withColumns(turned).drop("_roll", "_cx", "_cy")


def scale_series(frames: DataFrame, cal: DataFrame, height_cm: float, aspect: float = ASPECT) -> DataFrame:
    """``cm`` per unit and frame: body height over its picture height, corrected by the trunk's picture length within 0.5 and 2."""
    f = frames.join(cal.select(*CLIP, F.col("trunk").alias("_trunk"), F.col("height").alias("_height")), CLIP)
    own = F.when(_trunk(aspect) > 1e-6, _trunk(aspect)).otherwise(F.col("_trunk"))
    ratio = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("_trunk") / own))
    return f.select(*CLIP, "frame", (F.lit(height_cm) / F.col("_height") * ratio).alias("cm"))


def quality(frames: DataFrame, stats: DataFrame | None = None, fps: float = 30.0) -> DataFrame:
    """Issues per clip in a fixed order, what cuts a partial swing, and ``usable``: somebody seen on most frames, half a second
    long, enough light. ``stats``: clip_id, frame, mean_luma, blur_score, person_height_frac."""
    joined = frames.join(stats, [*CLIP, "frame"], "left") if stats is not None else frames.withColumns({c: F.lit(None).cast("double") for c in ("mean_luma", "blur_score", "person_height_frac")})
    e = motion_energy(joined).withColumn("_at", F.row_number().over(series.window(CLIP, ORDER))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*CLIP)))
    side = F.greatest(F.lit(2), F.floor(F.col("_n") * 0.08))
    near = (F.least(*[at(i, "x") for i in B.UPPER]) < EDGE_MARGIN) | (F.greatest(*[at(i, "x") for i in B.UPPER]) > 1 - EDGE_MARGIN)
    a = e.groupBy(*CLIP).agg(
        F.median("mean_luma").alias("luma"), F.median("blur_score").alias("blur"), F.median("person_height_frac").alias("size"), F.count(F.lit(1)).alias("frames"),
        F.avg(core_visibility(B.UPPER)).alias("visibility"), F.avg(near.cast("double")).alias("near_edge"), F.avg((F.col("vis_max") > 0.3).cast("double")).alias("seen"),
        F.avg(F.when(F.col("_at") <= side, F.col("energy"))).alias("head"), F.avg(F.when(F.col("_at") > F.col("_n") - side, F.col("energy"))).alias("tail"), F.max("energy").alias("peak"),
    )
    cut_head, cut_tail = (F.col("peak") > 0) & (F.col("head") > 0.5 * F.col("peak")), (F.col("peak") > 0) & (F.col("tail") > 0.5 * F.col("peak"))
    issues = F.array_compact(F.array(F.when(F.col("luma") < 45, "low_light"), F.when(F.col("blur") < 40, "motion_blur"), F.when(F.col("size") < 0.18, "player_too_far"), F.when(F.col("visibility") < 0.5, "partial_occlusion"), F.when(F.col("near_edge") > 0.25, "player_near_edge"), F.when(cut_head | cut_tail, "partial_swing")))
    detail = F.when(cut_head & cut_tail, "multiple").when(cut_head, "backswing_cut").when(cut_tail, "follow_through_cut")
    usable = (F.col("seen") > 0.5) & (F.col("frames") >= int(0.5 * fps)) & ~F.array_contains(issues, "low_light")
    return a.select(*CLIP, F.array_join(issues, ";").alias("issues"), detail.alias("swing_cut"), usable.alias("usable"), "visibility", "near_edge")


def tracked(frames: DataFrame, hand: str = "R") -> DataFrame:
    """Adds the frame of every keyframe (NULL where it is not found), ``impact_ms``, and the helpers ``_at, _n, _wx, _wy, _v, _tall``.

    impact: fastest wrist outside the outer 15 %, its time refined by a parabola through its neighbours; backswing_peak: wrist
    farthest from the hip centre across before it; unit_turn: first rotation of 30 % of the largest before that;
    follow_through_peak: wrist farthest from the hip centre within a second after; ready_restored: first of three rows in the
    ready pose after that, within 12 % of the body height."""
    side = handed(frames, hand)
    clip, w = Window.partitionBy(*CLIP), series.window(CLIP, ORDER)
    f = rotation_proxy(frames).withColumn("_s", F.col("t_ms") / 1000).withColumn("_wx", F.coalesce(at(side["wrist"], "x"), F.lit(0.0))).withColumn("_wy", F.coalesce(at(side["wrist"], "y"), F.lit(0.0)))
    f = f.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(clip)).withColumn("_tall", body_height(clip))
    f = series.speed(f, CLIP, ORDER, ["_wx", "_wy"], "_s", "_v").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.15))
    f = f.withColumn("_search", F.when((F.col("_at") < cut) | (F.col("_at") >= F.col("_n") - cut), 0.0).otherwise(F.col("_v")))
    hx, hy = at(side["wrist"], "x") - mid(23, 24, "x"), at(side["wrist"], "y") - mid(23, 24, "y")
    f = f.withColumn("_hx", hx).withColumn("_hy", hy).withColumn("_dx", F.coalesce(F.abs("_hx"), F.lit(0.0))).withColumn("_d", F.coalesce(B.norm(F.col("_hx"), F.col("_hy")), F.lit(0.0))).withColumn("_st", F.abs(at(28, "x") - at(27, "x")))
    y0, y1, y2 = F.lag("_v").over(w), F.col("_v"), F.lead("_v").over(w)
    bend = y0 - 2 * y1 + y2
    offset = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (y0 - y2) / bend))
    f = f.withColumn("_fine", F.when(F.abs(bend) >= 1e-12, F.col("t_ms") + offset * (F.lead("t_ms").over(w) - F.col("t_ms"))).otherwise(F.col("t_ms")))
    f = f.withColumn("_fine", F.coalesce("_fine", "t_ms"))
    best = lambda v, *more: F.struct(v, (-F.col("_at")).alias("_o"), *more)
    f = f.withColumn("_i", F.max(best("_search", "t_ms", "_fine")).over(clip)).withColumn("_i", F.when(F.col("_i._search") > 0, F.col("_i")))
    f = f.withColumn("impact", -F.col("_i._o")).withColumn("impact_ms", F.col("_i._fine"))
    f = f.withColumn("_b", F.max(F.when((F.col("_at") < F.col("impact")) & (F.col("impact") > 2), best("_dx"))).over(clip))
    f = f.withColumn("backswing_peak", F.when(F.col("_b._dx") > 0.02, -F.col("_b._o")))
    turning = (F.col("_at") < F.col("backswing_peak")) & (F.col("backswing_peak") > 1)
    f = f.withColumn("_top", F.max(F.when(turning, F.col("rot"))).over(clip))
    f = f.withColumn("unit_turn", F.min(F.when(turning & (F.col("_top") > 0.05) & (F.col("rot") >= 0.3 * F.col("_top")), F.col("_at"))).over(clip))
    after = (F.col("t_ms") > F.col("_i.t_ms")) & (F.col("t_ms") <= F.col("_i.t_ms") + 1000)
    f = f.withColumn("_f", F.max(F.when(after, best("_d"))).over(clip)).withColumn("follow_through_peak", F.when(F.count_if(after).over(clip) >= 2, -F.col("_f._o")))
    early = F.col("_at") < F.greatest(F.lit(2), F.floor(F.col("_n") * 0.1))
    for out, v in (("_rx", "_hx"), ("_ry", "_hy"), ("_rs", "_st")):
        f = f.withColumn(out, F.avg(F.when(early, F.col(v))).over(clip))
    ok = (B.norm(F.col("_hx") - F.col("_rx"), F.col("_hy") - F.col("_ry")) / F.col("_tall") < READY_TOLERANCE) & (F.abs(F.col("_st") - F.col("_rs")) / F.col("_tall") < READY_TOLERANCE)
    held = F.when(F.col("_at") > F.col("follow_through_peak"), F.coalesce(ok.cast("int"), F.lit(0)))
    f = f.withColumn("_held", held).withColumn("_run", F.sum("_held").over(w.rowsBetween(0, 2)))
    f = f.withColumn("ready_restored", F.min(F.when((F.col("_at") > F.col("follow_through_peak")) & (F.col("_run") == 3), F.col("_at"))).over(clip))
    return f.drop("_s", "_search", "_hx", "_hy", "_dx", "_d", "_st", "_fine", "_i", "_b", "_top", "_f", "_rx", "_ry", "_rs", "_held", "_run")


def keyframes(track: DataFrame) -> DataFrame:
    """One row per clip with the frame of every keyframe and ``impact_ms``, of ``tracked``'s table."""
    return track.groupBy(*CLIP).agg(*[F.first(k).alias(k) for k in (*KEYFRAMES, "impact_ms")])


def _pick(key, value: Column) -> Column:
    """The value at a keyframe."""
    return F.max(F.when(F.col("_at") == (F.col(key) if isinstance(key, str) else key), value))


def class_features(track: DataFrame, hand: str = "R") -> list[Column]:
    """Aggregates that a stroke's type follows from."""
    side = handed(track, hand)
    wx, wy = at(side["wrist"], "x"), at(side["wrist"], "y")
    off = wx - (mid(11, 12, "x") + mid(23, 24, "x")) / 2
    ref = F.coalesce("backswing_peak", F.greatest(F.lit(0), F.col("impact") - 5))
    return [
        (F.median(at(0, "y")) - F.min(F.when(F.col("_at").between(F.col("impact") - 5, F.col("impact") + 5), wy))).alias("overhead"),
        (F.max(F.when(F.col("_at") < F.col("impact"), F.abs(off))) / F.first("_tall")).alias("amplitude"),
        (_pick(ref, off) * (1 if hand == "R" else -1)).alias("side"),
        F.degrees(F.atan2(_pick("backswing_peak", wy) - _pick("impact", wy), F.abs(_pick("impact", wx) - _pick("backswing_peak", wx)) + F.lit(1e-9))).alias("path"),
        F.first("_tall").alias("_tall"), F.first("impact").alias("_impact"),
    ]


def typed(features: DataFrame) -> DataFrame:
    """Adds ``stroke_type`` and ``confidence`` to a table with the aggregates of ``class_features``."""
    ground = F.when(F.col("side") > 0, "FH").otherwise("BH")
    serve, volley, slice_ = F.col("overhead") > OVERHEAD_MARGIN, F.col("amplitude") < COMPACT_AMPLITUDE, (ground == "BH") & (F.col("path") < SLICE_PATH)
    sure_side = B.confidence_from_margin(F.col("side"), 0.25 * F.col("_tall"))
    kind = F.when(F.col("_impact").isNull(), "FH").when(serve, "SV").when(volley, "VL").when(slice_, "SL").otherwise(ground)
    sure = F.when(F.col("_impact").isNull(), 0.5).when(serve, B.confidence_from_margin(F.col("overhead") - OVERHEAD_MARGIN, 0.15)).when(volley, B.confidence_from_margin(COMPACT_AMPLITUDE - F.col("amplitude"), 0.2))
    sure = sure.when(slice_, F.least(sure_side, B.confidence_from_margin(SLICE_PATH - F.col("path"), 20.0))).otherwise(sure_side)
    return features.withColumn("stroke_type", kind).withColumn("confidence", sure)


def classify(track: DataFrame, hand: str = "R") -> DataFrame:
    """Stroke type, confidence and the features it rests on: a wrist over the head around impact is a serve, a backswing that stays
    near the trunk a volley, else the side of the backswing tells forehand from backhand, and a backhand whose path falls
    steeply is a slice. Without impact: forehand, 0.5."""
    a = typed(track.groupBy(*CLIP).agg(*class_features(track, hand)))
    return a.select(*CLIP, "stroke_type", "confidence", F.create_map(*[x for n in ("overhead", "amplitude", "side", "path") for x in (F.lit(n), F.col(n))]).alias("features"))


def confidence_block(track: DataFrame) -> DataFrame:
    """Mean core visibility from unit turn to follow-through (from the first or to the last frame where one is missing, over the clip
    without impact), share of hidden frames, and whether no landmark jumps by 24 % of the body height between frames."""
    w = series.window(CLIP, ORDER)
    x, y = (lambda i: F.coalesce(at(i, "x"), F.lit(0.0))), (lambda i: F.coalesce(at(i, "y"), F.lit(0.0)))
    jump = F.greatest(*[B.norm(x(i) - F.lag(x(i)).over(w), y(i) - F.lag(y(i)).over(w)) for i in B.CORE])
    f = track.withColumn("_c", core_visibility()).withColumn("_jump", jump)
    inside = F.col("impact").isNull() | ((F.col("_at") >= F.coalesce("unit_turn", F.lit(0))) & (F.col("_at") <= F.coalesce("follow_through_peak", F.col("_n"))))
    clean = F.coalesce(F.max("_jump"), F.lit(0.0)) < JUMP_RATIO * F.greatest(F.first("_tall"), F.lit(1e-6)) * 3
    return f.groupBy(*CLIP).agg(F.round(F.avg(F.when(inside, F.col("_c"))), 2).alias("pose_confidence"), F.avg((F.col("_c") < 0.5).cast("double")).alias("hidden"), clean.alias("clean"))


def stroke_root(keys: DataFrame, conf: DataFrame, issues: DataFrame) -> DataFrame:
    """Detection status (failed: none of the four keyframes of the swing), clean flag (these four, no issue) and the recommended
    action: failed and low confidence are discarded, partial and unclean strokes go to a coach."""
    from .sessions import recommended_action

    j = keys.join(conf, CLIP).join(issues.select(*CLIP, "issues"), CLIP)
    found = lambda names: sum((F.col(k).isNotNull().cast("int") for k in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    swing = KEYFRAMES[:4]
    status = F.when(found(KEYFRAMES) == len(KEYFRAMES), "valid").when(found(swing) == 0, "failed").otherwise("partial")
    clean = (found(swing) == len(swing)) & (F.col("issues") == "")
    by_confidence = recommended_action(F.col("pose_confidence"))
    action = F.when((status == "failed") | (by_confidence == "discard"), "discard").when((status == "partial") | ~clean, "coach_review").otherwise(by_confidence)
    return j.select(*CLIP, status.alias("status"), clean.alias("is_clean"), action.alias("action"))
