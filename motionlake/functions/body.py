"""Column expressions for geometry and body measures. No UDF: every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Landmark numbers of a 33-point body model and the weights of the body's parts.
NOSE, L_EAR, R_EAR = 0, 7, 8
L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST = 11, 12, 13, 14, 15, 16
L_INDEX, R_INDEX, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE = 19, 20, 23, 24, 25, 26, 27, 28
UPPER = (L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST)
CORE = (*UPPER, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE)
TRUNK = (L_SHOULDER, R_SHOULDER, L_HIP, R_HIP)
TRUNK_MASS, UPPER_ARM_MASS, FOREARM_MASS, THIGH_MASS, SHANK_MASS = 0.50, 0.03, 0.02, 0.10, 0.10
#: Segments by their end landmarks, of either side, with the part of the body's mass.
SEGMENTS = (
    (L_SHOULDER, L_ELBOW, UPPER_ARM_MASS), (R_SHOULDER, R_ELBOW, UPPER_ARM_MASS), (L_ELBOW, L_WRIST, FOREARM_MASS), (R_ELBOW, R_WRIST, FOREARM_MASS),
    (L_HIP, L_KNEE, THIGH_MASS), (R_HIP, R_KNEE, THIGH_MASS), (L_KNEE, L_ANKLE, SHANK_MASS), (R_KNEE, R_ANKLE, SHANK_MASS),
)
VISIBLE, LOW = 0.80, 0.50


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle at b in degrees; NULL where an arm of it has no length."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    d = norm(ux, uy) * norm(vx, vy)
    return F.when(d > 1e-9, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / d)))))


def rotation_deg(dx: Column, dz: Column) -> Column:
    """Turn of a left-right pair out of the picture plane, in degrees."""
    return F.degrees(F.atan2(dz, F.abs(dx) + 1e-9))


def line_angle_deg(dx: Column, dy: Column) -> Column:
    """Direction of a picture line in [0, 180)."""
    a = F.degrees(F.atan2(dy, dx))
    return a - F.floor(a / 180) * 180


def cosine(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    d = norm(ux, uy) * norm(vx, vy)
    return F.when(d > 0, (ux * vx + uy * vy) / d)


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A picture point turned about (cx, cy)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def visibility_flag(mean: Column, cap: bool = False) -> Column:
    """visible, low_confidence or not_detectable; ``cap`` lowers the first to the second."""
    top = "low_confidence" if cap else "visible"
    return F.when(mean >= VISIBLE, top).when(mean >= LOW, "low_confidence").otherwise("not_detectable")


def uncrop(x: Column, y: Column, x0: Column, y0: Column, cw: Column, ch: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Crop-normalised to frame-normalised coordinates."""
    return (x * cw + x0) / width, (y * ch + y0) / height


def confidence_from_margin(margin: Column, scale: float) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + F.abs(margin) / scale * 0.45))


def height_cm(pixels: Column, depth_m: Column, focal: Column) -> Column:
    """Body height from its picture height; NULL outside 100 to 220 cm."""
    h = pixels * depth_m / focal * 100
    return F.when(h.between(100.0, 220.0), h)


def union_box(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> tuple[Column, Column, Column, Column]:
    x, y = F.least(ax, bx), F.least(ay, by)
    return x, y, F.greatest(ax + aw, bx + bw) - x, F.greatest(ay + ah, by + bh) - y


def known(x: Column) -> Column:
    """NaN to NULL, for values that arrive from arrays."""
    return F.when(~F.isnan(x), x)
