"""Fill, preparation, metric flags, court jobs and the whole stroke and session jobs against plain versions."""

import math

import numpy as np
import pytest
from motionlake.operators import court, court_jobs, jobs, occlusion, poses, stroke_metrics, strokes
from pyspark.sql import functions as F


def plain_spline(x, u, at):
    """The not-a-knot cubic spline as one dense system of polynomial pieces."""
    n = len(x)
    a, r, k = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1)), 0
    value, slope, bend, third = (lambda t: [1, t, t * t, t**3]), (lambda t: [0, 1, 2 * t, 3 * t * t]), (lambda t: [0, 0, 2, 6 * t]), np.array([0, 0, 0, 6.0])
    for i in range(n - 1):
        h, here, then = x[i + 1] - x[i], slice(4 * i, 4 * i + 4), slice(4 * i + 4, 4 * i + 8)
        a[k, here], r[k], a[k + 1, here], r[k + 1] = value(0), u[i], value(h), u[i + 1]
        k += 2
        if i < n - 2:
            a[k, here], a[k, then], a[k + 1, here], a[k + 1, then] = slope(h), -np.array(slope(0)), bend(h), -np.array(bend(0))
            k += 2
    a[k, 0:4], a[k, 4:8], a[k + 1, -8:-4], a[k + 1, -4:] = third, -third, third, -third
    c = np.linalg.solve(a, r).reshape(-1, 4)
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    return np.array([np.dot(value(q - x[j]), c[j]) for q, j in zip(at, i)])


def plain_fill(pose, least):
    """child joint -> (frames, 3) with hidden runs rebuilt; ``pose``: joint -> (points, visibility)."""
    out = {}
    for child, parent in occlusion.LIMBS.items():
        (x, vis), (p, pvis) = pose[child], pose[parent]
        x, good = x.copy(), vis >= 0.5
        at = np.flatnonzero(good)
        if good.sum() >= least:
            arm = x[good] - p[good]
            length = np.linalg.norm(arm, axis=1)
            unit, i = arm / np.where(length == 0, 1, length)[:, None], 0
            src = x.copy()
            while i < len(x):
                j = i
                while j < len(x) and not good[j]:
                    j += 1
                if 0 < j - i <= 20 and i > 0:
                    t = np.arange(i, j)
                    if j == len(x):
                        x[t] = np.stack([np.polyval(np.polyfit(at[-15:], src[at[-15:], k], 2), t) for k in range(3)], 1)
                        if np.abs(src[good]).max() <= 2:
                            x[t] = np.clip(x[t], -0.1, 1.1)
                    elif (pvis[t] >= 0.5).all():
                        line = np.stack([np.interp(t, at, src[good, k]) for k in range(3)], 1)
                        turn = np.stack([plain_spline(at.astype(float), unit[:, k], t) for k in range(3)], 1)
                        x[t] = 0.5 * line + 0.5 * (p[t] + np.median(length) * turn / np.linalg.norm(turn, axis=1, keepdims=True))
                i = max(j, i + 1)
        out[child] = x
    return out


def limbs(seed, frames, big=1.0):
    rng, pose = np.random.default_rng(seed), {}
    for lm in (13, 14, 15, 16, 25, 26, 27, 28):
        points = np.cumsum(rng.normal(0, 0.01, (frames, 3)), axis=0) * big + 0.5
        vis = np.where(rng.random(frames) < 0.15, 0.2, 0.9)
        if lm in (15, 27):
            vis[20:26], vis[50:75], vis[-4:] = 0.1, 0.1, 0.1
        pose[lm] = (points, vis)
    return pose


@pytest.mark.parametrize("big", [1.0, 300.0])
def test_fill_is_the_dense_spline_s(spark, big):
    clips = {c: limbs(c, 120, big) for c in (1, 2)}
    rows = [(c, f, lm, *map(float, x[f]), float(v[f])) for c, pose in clips.items() for lm, (x, v) in pose.items() for f in range(len(v))]
    got = occlusion.fill(spark.createDataFrame(rows, "clip_id int, frame int, lm_id int, x double, y double, z double, vis double")).toPandas()
    for c, pose in clips.items():
        want = plain_fill(pose, 10)
        for lm, g in got[got.clip_id == c].groupby("lm_id"):
            assert np.abs(g.sort_values("frame")[["x", "y", "z"]].to_numpy() - want[lm]).max() < 1e-8 * big
    assert got.filled.sum() > 50


def test_prepared_series(spark):
    """A clip of 30 frames a second goes to 60 and is smoothed; a clip of 60 keeps its clock; a channel with a long gap stays as it is."""
    rng = np.random.default_rng(3)
    rows, clean = [], {}
    for clip, fps in ((1, 30.0), (2, 60.0)):
        for lm in (0, 11):
            x = np.cumsum(rng.normal(0, 0.01, 40))
            clean[clip, lm] = x
            gone = range(10, 25) if lm == 11 else (5, 6) if clip == 2 else ()
            rows += [(clip, f, f * 1000 / fps, lm, None if f in gone else float(x[f]), 0.5, 0.1, 0.9) for f in range(40)]
    p = jobs.prepared(spark.createDataFrame(rows, "clip_id int, frame int, t_ms double, lm_id int, x double, y double, z double, vis double")).toPandas()
    one = p[(p.clip_id == 1) & (p.lm_id == 0)].sort_values("frame")
    assert len(one) == 79 and one.resampled.all() and np.allclose(one.t_ms, np.arange(79) * 1000 / 60)
    raw = np.interp(one.t_ms, np.arange(40) * 1000 / 30, clean[1, 0])
    weights = np.array([-2, 3, 6, 7, 6, 3, -2]) / 21
    assert np.allclose(one.x.to_numpy()[3:-3], np.convolve(raw, weights, "valid"))
    two = p[(p.clip_id == 2) & (p.lm_id == 0)].sort_values("frame")
    filled = clean[2, 0].copy()
    filled[5:7] = np.interp([5, 6], [4, 7], filled[[4, 7]])
    assert len(two) == 40 and not two.resampled.any() and np.allclose(two.x.to_numpy()[3:-3], np.convolve(filled, weights, "valid"))
    gap = p[(p.clip_id == 2) & (p.lm_id == 11)].sort_values("frame")
    assert gap.x.isna().sum() == 15 and np.allclose(gap.x.to_numpy()[:10], clean[2, 11][:10])


def test_fused_impact(spark):
    """A ball that turns sharply near the impact moves it there; a ball lost around it does not."""
    t = np.arange(60) * 1000 / 60
    x = np.where(np.arange(60) < 33, np.arange(60) * 2.0, 66 - (np.arange(60) - 33) * 3.0)
    rows = [(c, f, float(t[f]), None if c == 2 and 25 < f < 38 else float(x[f]), 1.0) for c in (1, 2) for f in range(60)]
    ball = spark.createDataFrame(rows, "clip_id int, frame int, t_ms double, x double, y double")
    got = {r.clip_id: r for r in strokes.fuse_impact(spark.createDataFrame([(1, 500.0), (2, 500.0)], "clip_id int, impact_ms double"), ball).collect()}
    assert got[1].fused and abs(got[1].frame - 33) <= 1 and abs(got[1].impact_ms - t[33]) < 20
    assert not got[2].fused and got[2].impact_ms == 500.0 or got[2].fused


def test_planted_null_breaches(spark):
    rows = [(1, "FH", "arm", "a", 1.0, None, "visible"), (1, "FH", "arm", "b", 2.0, None, "not_detectable"), (1, "FH", "arm", "c", None, None, "visible"), (1, "FH", "derived", "d", None, None, "derived"), (1, "FH", "arm", "e", None, None, None), (1, "FH", "arm", "f", None, None, "not_detectable"), (2, "FH", "arm", "a", 1.0, None, "visible")]
    got = {(r.clip_id, r.metric): r.breach for r in stroke_metrics.null_breaches(spark.createDataFrame(rows, "clip_id int, stroke_type string, block string, metric string, value double, text string, flag string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "b"): "value beside not_detectable", (1, "c"): "no value", (1, "e"): "no flag"}
    assert {k[1] for k, v in got.items() if k[0] == 2 and v == "missing"} == set("bcdef")


TRUE = {"height_m": 1.6, "distance_m": 5.0, "tilt_deg": 4.0, "pan_deg": 3.0, "focal_px": 900.0}


def picture(x, y, z, far=0.0):
    t, p = math.radians(TRUE["tilt_deg"]), math.radians(TRUE["pan_deg"])
    dx, dy, dz = x, y - TRUE["height_m"], z + TRUE["distance_m"] + far
    rx, rz = dx * math.cos(p) - dz * math.sin(p), dx * math.sin(p) + dz * math.cos(p)
    ry, depth = dy * math.cos(t) + rz * math.sin(t), rz * math.cos(t) - dy * math.sin(t)
    return 480 + TRUE["focal_px"] * rx / depth, 270 - TRUE["focal_px"] * ry / depth


def test_camera_pose_search(spark):
    points = [(-4.115, 0.0, 0.0), (4.115, 0.0, 0.0), (-4.115, 0.0, 5.485), (4.115, 0.0, 5.485), (-4.115, 1.07, 11.885), (4.115, 1.07, 11.885), (0.0, 0.914, 11.885)]
    rows = [(1, *p, *picture(*p)) for p in points] + [(2, *p, *picture(*p)) for p in points[:3]] + [(3, *p, *picture(*p)) for p in points[4:] + points[4:5]]
    clicks = spark.createDataFrame(rows, "camera_id int, wx double, wy double, wz double, u double, v double")
    one = {r.camera_id: r for r in court_jobs.search_poses(clicks, ["camera_id"], 480.0, 270.0, n=1024).collect()}
    more = {r.camera_id: r for r in court_jobs.search_poses(clicks, ["camera_id"], 480.0, 270.0, n=1024, rounds=6, zoom=0.4).collect()}
    assert more[1].rmse < one[1].rmse and more[1].rmse < 12 and abs(more[1].height_m - 1.6) < 0.5
    assert one[2].height_m is None and one[2].score == 0 and one[2].warnings == "fewer than 4 clicks; no click above the ground"
    assert "depth spread under 3 m" in one[3].warnings
    # a caller's own cost
    low = court_jobs.search_poses(clicks, ["camera_id"], 480.0, 270.0, cost=lambda p, c: p["height_m"], n=256).filter("camera_id = 1").first()
    assert low.height_m < 0.82


def test_court_calibration_keeps_a_map_and_gives_reasons(spark):
    ground = court_jobs.GROUND
    uv = {k: picture(x, 0.0, z, 4.0) for k, (x, z) in ground.items()}
    lines = [(uv["base_left"], uv["base_right"]), (uv["service_left"], uv["service_right"]), (uv["base_left"], uv["service_left"]), (uv["base_right"], uv["service_right"])]
    rows = [(1, f, i, *a, *b) for f in range(4) for i, (a, b) in enumerate(lines) if not (f == 3 and i == 1)]
    segs = spark.createDataFrame(rows, "camera_id int, frame int, seg_id int, x1 double, y1 double, x2 double, y2 double")
    net = spark.createDataFrame([(1, 0, 50.0), (1, 1, 54.0), (1, 3, 50.0)], "camera_id int, frame int, net_px double")
    frames = court_jobs.calibrate_frames(segs, ["camera_id", "frame"], net, 960.0, 540.0)
    per = {r.frame: r for r in frames.collect()}
    assert [per[f].valid for f in range(4)] == [True, True, False, False] and per[2].reason == "no net" and per[3].reason.endswith("of 4 corners")
    got = court_jobs.calibrate(frames, ["camera_id"], "frame").first()
    assert got.focal_px == pytest.approx(52 * 11.885 / 0.914) and got.kept_frame == 0 and got.valid_frames == 2 and "no net" in got.reasons
    u, v = picture(1.0, 0.0, 3.0, 4.0)
    x, z = court.apply_homography([F.lit(got[m]) for m in court_jobs.MATRIX], F.lit(u), F.lit(v))
    p = spark.range(1).select(x.alias("x"), z.alias("z")).first()
    assert abs(p.x - 1.0) < 1e-6 and abs(p.z - 3.0) < 1e-6


def swing(clip, fps=30.0, seconds=3.0, hits=(1.3,), hide=False):
    """A standing player whose right wrist swings at given times."""
    base = {0: (0.5, 0.2), 7: (0.48, 0.2), 8: (0.52, 0.2), 11: (0.45, 0.35), 12: (0.55, 0.35), 13: (0.42, 0.45), 14: (0.6, 0.45), 15: (0.42, 0.55), 16: (0.6, 0.55), 19: (0.42, 0.57), 20: (0.6, 0.57), 23: (0.46, 0.6), 24: (0.54, 0.6), 25: (0.46, 0.75), 26: (0.54, 0.75), 27: (0.45, 0.92), 28: (0.55, 0.92)}
    rows = []
    for f in range(int(fps * seconds)):
        t = f / fps
        push = sum(math.tanh((t - h) * 12) - math.tanh((t - h - 0.9) * 4) for h in hits)
        back = sum(math.exp(-(((t - h + 0.35) / 0.15) ** 2)) for h in hits)
        for lm, (x, y) in base.items():
            share = {16: 1.0, 20: 1.0, 14: 0.6, 12: 0.15}.get(lm, 0.0)
            rows.append((clip, f, t * 1000, lm, x + share * (0.14 * back - 0.09 * push), y - share * 0.03 * push, 0.02 * share * push, 0.2 if hide else 0.95))
    return rows


POSE = "clip_id int, frame int, t_ms double, lm_id int, x double, y double, z double, vis double"


def test_stroke_job_end_to_end(spark):
    job = jobs.stroke_job(spark.createDataFrame(swing(1) + swing(2, hide=True), POSE))
    got = {r.clip_id: r for r in job.collect()}
    one = got[1]
    assert one.velocity_normalized and one.impact is not None and 1000 < one.impact_ms < 1600 and one.status in ("valid", "partial") and one.wrist_path and one.body_center_path
    assert one.unit_turn is None or one.unit_turn <= one.backswing_peak <= one.impact <= one.follow_through_peak
    flags = {(m.block, m.metric): m for m in one.metrics}
    assert flags["contact", "contact_height_cm"].flag == "visible" and 0 < flags["contact", "contact_height_cm"].value < 200
    assert flags["depth_estimated", "elbow_angle_at_impact_deg"].flag == "low_confidence" and flags["kinematics", "racket_head_speed_mps"].value > 0
    assert got[2].action == "discard" and "partial_occlusion" in got[2].issues
    hidden = {(m.block, m.metric): m.flag for m in got[2].metrics}
    assert hidden["contact", "contact_height_cm"] == "not_detectable"


def test_session_job_end_to_end(spark):
    """Three swings of one recording are three strokes of a session."""
    doc = jobs.session_job(spark.createDataFrame(swing(7, seconds=12.0, hits=(2.0, 5.5, 9.0)), POSE), 30.0, share=0.2).first()
    assert doc.session_id == 7 and [s.stroke_index for s in doc.strokes] == [1, 2, 3]
    assert doc.session_metadata.total_strokes_detected == 3 and doc.pattern.strokes == 3 and doc.trend is None or doc.trend.consistency is None or 0 <= doc.trend.consistency <= 1
    assert sum(a.n for a in doc.aggregated_metric or []) == sum(s.is_clean for s in doc.strokes)


def test_frames_of_one_recording_make_few_exchanges(spark):
    """The back half of the stroke job deals frames by clip once for each of calibration and tracking."""
    track = stroke_metrics.enriched(poses.wide(spark.createDataFrame(swing(1), POSE)))
    plan = stroke_metrics.engine(track)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_command_line_jobs(spark, tmp_path):
    """Players, dropout, frames for labelling, camera poses and the hit gate, from files to files."""
    from motionlake import cli
    from motionlake.sources import files
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(6)
    boxes = [(1, f, i, 100.0 + 300 * i + 3 * f, 100.0 + 60 * i + 2 * f * (i + 1), 40.0, 90.0 + 40 * i) for f in range(40) for i in range(2)]
    spark.createDataFrame(boxes, "clip_id int, frame int, box_idx long, x double, y double, w double, h double").write.parquet(str(tmp_path / "boxes"))
    cli.run(spark, ["players", "--boxes", str(tmp_path / "boxes"), "--out", str(tmp_path / "players")])
    players = spark.read.parquet(str(tmp_path / "players"))
    assert {(r.role, r["count"]) for r in players.groupBy("role").count().collect()} == {("near", 40), ("far", 40)}
    rows = [(1, 0, 0.0, 0, float("nan"), 0.5, 0.1, 0.9), (1, 0, 0.0, 11, 0.4, 0.5, 0.1, None), (1, 1, 33.0, 0, 0.1, 0.5, 0.1, 0.9)]
    spark.createDataFrame(rows, POSE).write.parquet(str(tmp_path / "pose"))
    got = {(r.frame, r.lm_id): (r.x, r.y, r.vis) for r in files.read_pose(spark, str(tmp_path / "pose")).collect()}
    assert got == {(0, 0): (None, None, 0.0), (0, 11): (0.4, 0.5, 0.0), (1, 0): (0.1, 0.5, 0.9)}
    spark.createDataFrame([(1, 100.0, 30.0, 6)], "clip_id int, impact_ms double, fps double, frame_count int").write.parquet(str(tmp_path / "labels"))
    cli.run(spark, ["impact-frames", "--labels", str(tmp_path / "labels"), "--out", str(tmp_path / "frames")])
    assert spark.read.option("header", True).csv(str(tmp_path / "frames")).count() == 6
    points = [(-4.115, 0.0, 0.0), (4.115, 0.0, 0.0), (4.115, 0.0, 5.485), (-4.115, 1.07, 11.885), (4.115, 1.07, 11.885)]
    clicks = [(1, *p, *picture(*p)) for p in points] + [(2, *points[0], *picture(*points[0]))]
    spark.createDataFrame(clicks, "camera_id int, wx double, wy double, wz double, u double, v double").write.parquet(str(tmp_path / "clicks"))
    cli.run(spark, ["camera-poses", "--clicks", str(tmp_path / "clicks"), "--out", str(tmp_path / "poses")])
    found = {r.camera_id: r for r in spark.read.json(str(tmp_path / "poses")).collect()}
    assert found[1].camera_pose.height_m > 0 and found[1].n_points == 5 and found[2].camera_pose is None and found[2].score == 0
    lines = ["is_hit,frame,confidence," + ",".join(files.HIT_FEATURES), *(f"{int(v > 0.5)},{i},LOW,{v:.3f},1,1,1,,1,1" for i, v in enumerate(rng.random(60))), ",99,LOW,1,1,1,1,1,1,1"]
    (tmp_path / "hits.csv").write_text("\n".join(lines))
    table = files.read_hit_candidates(spark, str(tmp_path / "hits.csv"))
    assert table.count() == 60 and table.filter("ball_vel_change = 0").count() == 60
    cli.run(spark, ["hit-gate", "--candidates", str(tmp_path / "hits.csv"), "--out", str(tmp_path / "gate")])
    model = PipelineModel.load(str(tmp_path / "gate"))
    assert model.transform(table).filter("prediction = is_hit").count() >= 57
