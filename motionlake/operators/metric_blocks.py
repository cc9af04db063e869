"""Metric blocks of a stroke that need its type and scale: arm, contact, movement, and the enums derived from them.

All take ``measured``'s table, frames dealt by clip with keyframes, stroke type and centimetres, and are one grouped aggregate by
clip. A metric is NULL where a keyframe is missing or the stroke type has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import body as B
from . import poses
from .poses import CLIP, at, mid

# Limits of the rules, and the ideal distance of the contact from the body in cm by stroke type.
SPLIT_LIFT = 0.015
ZONE_LEFT, ZONE_RIGHT = 0.4, 0.6
CONTACT_IDEAL = {"FH": (15.0, 40.0), "BH": (15.0, 40.0), "SL": (15.0, 35.0), "RS": (10.0, 30.0), "VL": (15.0, 45.0)}


def measured(frames: DataFrame, height_cm: float = 170.0, hand: str = "R") -> DataFrame:
    """Tracked frames with ``stroke_type``, ``cm`` per unit and frame, ``cm_mid`` (its median), ``com_x``, ``com_y``, and ``load``: the
    share of the weight on the rear leg, the one nearer to the camera."""
    clip = Window.partitionBy(*CLIP)
    cal = poses.calibration(frames)
    track = poses.tracked(frames, hand)
    kind = poses.classify(track, hand).select(*CLIP, "stroke_type")
    t = track.join(kind, CLIP).join(poses.scale_series(frames, cal, height_cm), [*CLIP, "frame"])
    t = t.withColumn("cm_mid", F.median("cm").over(clip)).withColumn("com_x", poses.centre_of_mass("x")).withColumn("com_y", poses.centre_of_mass("y"))
    left = F.median(at(27, "z")).over(clip) < F.median(at(28, "z")).over(clip)
    t = t.withColumn("_xr", F.when(left, at(27, "x")).otherwise(at(28, "x"))).withColumn("_xf", F.when(left, at(28, "x")).otherwise(at(27, "x")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("com_x") - F.col("_xr")) / (F.col("_xf") - F.col("_xr")))) * 100
    return t.withColumn("load", F.when(F.abs(F.col("_xf") - F.col("_xr")) < 1e-6, 50.0).otherwise(share)).drop("_xr", "_xf")


def _without(types: tuple, value: Column) -> Column:
    return F.when(~F.first("stroke_type").isin(*types), value)


def arm(track: DataFrame, hand: str = "R") -> DataFrame:
    """Elbow angle at the follow-through and depth of the backswing (from the vertical, negative behind the body); neither for a serve."""
    side, sign = poses.handed(track, hand), 1 if hand == "R" else -1
    s, e, w = side["shoulder"], side["elbow"], side["wrist"]
    u, v = [at(s, a) - at(e, a) for a in "xyz"], [at(w, a) - at(e, a) for a in "xyz"]
    reach = B.norm(*u) * B.norm(*v)
    angle = F.when(reach > 1e-9, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / reach)))))
    depth = F.degrees(F.atan2(F.abs(at(w, "x") - at(s, "x")), at(w, "y") - at(s, "y") + F.lit(1e-9)))
    behind = (at(w, "x") - (mid(11, 12, "x") + mid(23, 24, "x")) / 2) * sign > 0
    return track.groupBy(*CLIP).agg(
        _without(("SV",), poses._pick("follow_through_peak", angle)).alias("follow_through_angle_deg"),
        _without(("SV",), poses._pick("backswing_peak", F.when(behind, -depth).otherwise(depth))).alias("backswing_depth_deg"),
    )


def contact(track: DataFrame, hand: str = "R") -> DataFrame:
    """Height of the contact and its distance from the body in cm, and the angle of the swing's path (not for serve and volley)."""
    side, sign = poses.handed(track, hand), 1 if hand == "R" else -1
    wx, wy = at(side["wrist"], "x"), at(side["wrist"], "y")
    pick = poses._pick
    path = F.degrees(F.atan2(pick("backswing_peak", wy) - pick("impact", wy), F.abs(pick("impact", wx) - pick("backswing_peak", wx)) + F.lit(1e-9)))
    return track.groupBy(*CLIP).agg(
        pick("impact", (mid(27, 28, "y") - wy) * F.col("cm")).alias("contact_height_cm"),
        pick("impact", (wx - (mid(11, 12, "x") + mid(23, 24, "x")) / 2) * sign * F.col("cm")).alias("contact_distance_cm"),
        _without(("VL", "SV"), path).alias("swing_path_deg"),
    )


def movement(track: DataFrame) -> DataFrame:
    """Split step before the unit turn, footwork and speed up to the impact, stance, weight transfer, and recovery."""
    clip, pick = Window.partitionBy(*CLIP), poses._pick
    before = F.col("_at") < F.col("unit_turn")
    for i in (27, 28):
        track = track.withColumn(f"_base{i}", F.median(F.when(before, at(i, "y"))).over(clip))
    lifted = [F.col(f"_base{i}") - at(i, "y") > SPLIT_LIFT * F.col("_tall") for i in (27, 28)]
    up = F.when(before & lifted[0] & lifted[1], F.struct("_at", "t_ms"))
    apex = F.element_at("_up", (F.floor(F.size("_up") / 2) + 1).cast("int"))["t_ms"]
    first = lambda v: F.max(F.when(F.col("_at") == 0, v))
    crossing = F.min(F.when((F.col("impact") > F.col("backswing_peak")) & F.col("_at").between(F.col("backswing_peak"), F.col("impact")) & (F.col("load") < 50), F.struct("_at", "t_ms")))["t_ms"]
    a = track.groupBy(*CLIP).agg(
        F.first("stroke_type").alias("stroke_type"), F.first("unit_turn").alias("_turn"), pick("unit_turn", F.col("t_ms")).alias("_turn_ms"), F.array_sort(F.collect_list(up)).alias("_up"),
        (B.norm(pick("impact", F.col("com_x")) - first(F.col("com_x")), pick("impact", F.col("com_y")) - first(F.col("com_y"))) * F.first("cm_mid")).alias("_moved"),
        ((pick("impact", F.col("t_ms")) - first(F.col("t_ms"))) / 1000).alias("_seconds"),
        pick("impact", F.abs(at(28, "x") - at(27, "x")) * F.col("cm")).alias("stance_width_cm"),
        pick("impact", F.degrees(F.atan2(F.abs(at(28, "z") - at(27, "z")), F.abs(at(28, "x") - at(27, "x")) + F.lit(1e-9)))).alias("stance_angle_deg"),
        (crossing - F.first("impact_ms")).alias("weight_timing_ms"),
        _without(("VL",), pick("backswing_peak", F.col("load"))).alias("rear_load_pct"),
        _without(("VL",), F.when(F.first("backswing_peak").isNotNull(), 100 - pick("impact", F.col("load")))).alias("front_transfer_pct"),
        (pick("ready_restored", F.col("t_ms")) - pick("follow_through_peak", F.col("t_ms"))).alias("recovery_ms"),
        (F.first("ready_restored") - F.first("follow_through_peak")).cast("double").alias("recovery_frames"),
        pick("ready_restored", F.col("com_x")).alias("_zone"),
    )
    swing = F.col("stroke_type") != "SV"
    split = F.when(swing & (F.col("_turn") >= 3), F.size("_up") >= 2)
    position = F.when(F.col("_zone").isNull(), "not_recovered").when(F.col("_zone") < ZONE_LEFT, "baseline_left").when(F.col("_zone") > ZONE_RIGHT, "baseline_right").otherwise("baseline_center")
    a = a.withColumn("split_step", split).withColumn("split_step_ms", F.when(split, apex - F.col("_turn_ms")))
    a = a.withColumn("footwork_cm", F.when(swing, F.col("_moved"))).withColumn("speed_mps", F.when(swing & (F.col("_seconds") > 0), F.col("_moved") / 100 / F.col("_seconds")))
    return a.withColumn("recovery_position", position).drop("stroke_type", "_turn", "_turn_ms", "_up", "_moved", "_seconds", "_zone")


# Least visibility of a landmark in use, and how far over the head a serve is met, in the light document's rules.
LIGHT_SEEN, LIGHT_OVERHEAD = 0.3, 0.05


def _angle3(a: int, b: int, c: int) -> Column:
    """Angle at b in space, 0 where an arm of it has no length."""
    u, v = [at(a, x) - at(b, x) for x in "xyz"], [at(c, x) - at(b, x) for x in "xyz"]
    nu, nv = B.norm(*u), B.norm(*v)
    cosine = (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / (nu * nv)
    return F.when((nu < 1e-6) | (nv < 1e-6), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def light_type(track: DataFrame, hand: str = "R") -> DataFrame:
    """The light classifier at the impact frame: ``stroke_type`` by wrist over nose, then by the side of the shoulders' middle; a
    forehand where nose, shoulders or wrist are not seen, or without impact."""
    w = poses.handed(track, hand)["wrist"]
    seen = (at(0, "vis") >= LIGHT_SEEN) & (at(11, "vis") >= LIGHT_SEEN) & (at(12, "vis") >= LIGHT_SEEN) & (at(w, "vis") >= LIGHT_SEEN)
    own_side = at(w, "x") > mid(11, 12, "x") if hand == "R" else at(w, "x") < mid(11, 12, "x")
    kind = F.when(~seen, "FH").when(at(w, "y") < at(0, "y") - LIGHT_OVERHEAD, "SV").when(own_side, "FH").otherwise("BH")
    return track.groupBy(*CLIP).agg(F.coalesce(poses._pick("impact", kind), F.lit("FH")).alias("stroke_type"))


def light(track: DataFrame, height_cm: float = 170.0, hand: str = "R") -> DataFrame:
    """The light document's block: rotations in the picture plane, arm angles, and the contact in cm, where the landmarks are seen."""
    side, pick = poses.handed(track, hand), poses._pick
    s, e, w = side["shoulder"], side["elbow"], side["wrist"]
    turn = lambda a, b: F.degrees(F.atan2(at(b, "y") - at(a, "y"), at(b, "x") - at(a, "x")))
    left, right = at(27, "vis") > LIGHT_SEEN, at(28, "vis") > LIGHT_SEEN
    ground = F.when(left & right, mid(27, 28, "y")).when(left, at(27, "y")).when(right, at(28, "y"))
    tall = F.abs(ground - at(0, "y"))
    cm = F.when((at(0, "vis") >= LIGHT_SEEN) & (tall >= 1e-6), F.lit(height_cm) / tall)
    seen = at(w, "vis") > LIGHT_SEEN
    tx, ty = (mid(11, 12, "x") + mid(23, 24, "x")) / 2, (mid(11, 12, "y") + mid(23, 24, "y")) / 2
    has = F.first("impact").isNotNull()
    return track.groupBy(*CLIP).agg(
        F.when(has, pick("unit_turn", turn(11, 12))).alias("shoulder_turn_deg"), F.when(has, pick("unit_turn", turn(23, 24))).alias("hip_turn_deg"),
        pick("impact", turn(11, 12)).alias("shoulder_impact_deg"), pick("impact", turn(23, 24)).alias("hip_impact_deg"), pick("impact", turn(11, 12) - turn(23, 24)).alias("separation_deg"),
        F.when(has, pick("follow_through_peak", _angle3(s, e, w))).alias("follow_through_angle_deg"), F.when(has, pick("backswing_peak", _angle3(s, e, w))).alias("backswing_depth_deg"),
        pick("impact", F.when(seen, F.abs(ground - at(w, "y")) * cm)).alias("contact_height_cm"), pick("impact", F.when(seen, B.norm(at(w, "x") - tx, at(w, "y") - ty) * cm)).alias("contact_distance_cm"),
    )
