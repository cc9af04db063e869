"""Literal cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from motionlake.functions import body as B
from motionlake.operators import court, evaluation, fold, hits, joins, poses, series, sessions, tracks
from motionlake.sources import files, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def signal(spark, values, clip=1):
    return spark.createDataFrame([(clip, i, i * 1000 / 30, v) for i, v in enumerate(values)], "clip_id int, frame int, t_ms double, x double")


def test_gradient_is_one_sided_at_the_ends(spark):
    s = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate([(0.0, 0.0), (1.0, 1.0), (3.0, 9.0)])], "clip_id int, frame int, t double, x double")
    assert [r[0] for r in rows(series.gradient(s, ["clip_id"], ["frame"], "x", "t", "v").select("v", "frame"), "frame")] == [1.0, 3.0, 4.0]


def test_short_gaps_fill_and_long_ones_stay(spark):
    s = signal(spark, [None, 1.0, None, 3.0, None, None, None, 7.0, None])
    got = [r[1] for r in rows(series.fill_gaps(s, ["clip_id"], ["frame"], "x", 2, "f").select("frame", "f"), "frame")]
    assert got == [1.0, 1.0, 2.0, 3.0, None, None, None, 7.0, 7.0]
    inner = [r[1] for r in rows(series.fill_gaps(s, ["clip_id"], ["frame"], "x", 2, "f", edges=False).select("frame", "f"), "frame")]
    assert inner == [None, 1.0, 2.0, 3.0, None, None, None, 7.0, None]


def test_savgol_keeps_parabolas_and_gappy_series(spark):
    s = signal(spark, [0.5 * i * i for i in range(12)])
    got = [r[1] for r in rows(series.savgol(s, ["clip_id"], ["frame"], "x", "s").select("frame", "s"), "frame")]
    assert got == pytest.approx([0.5 * i * i for i in range(12)])
    gappy = signal(spark, [1.0, None, 5.0, 2.0, 8.0, 1.0, 0.0, 3.0])
    assert [r[1] for r in rows(series.savgol(gappy, ["clip_id"], ["frame"], "x", "s").select("frame", "s"), "frame")] == [1.0, None, 5.0, 2.0, 8.0, 1.0, 0.0, 3.0]


def test_resample_interpolates_and_keeps_holes(spark):
    s = spark.createDataFrame([(1, t, x) for t, x in [(0.0, 0.0), (100.0, 10.0), (200.0, None), (300.0, None), (400.0, 40.0)]], "clip_id int, t double, x double")
    got = rows(series.resample(s, ["clip_id"], "t", ["x"], 50.0).select("grid", "x"), "grid")
    assert got[:4] == [(0, 0.0), (1, 5.0), (2, 10.0), (3, 15.0)] and got[5] == (5, None) and got[8] == (8, 40.0)


def test_bounce_in_the_middle(spark):
    y = [10.0, 20.0, 30.0, 40.0, 50.0, 40.0, 30.0, 20.0, 10.0]
    ball = signal(spark, [0.0] * 9).withColumn("y", F.element_at(F.array(*[F.lit(v) for v in y]), F.col("frame") + 1))
    assert [r.frame for r in hits.bounces(ball).collect()] == [4]


def test_dedup_compares_with_the_kept_event(spark):
    s = spark.createDataFrame([(1, f, v) for f, v in [(0, 5.0), (10, 4.0), (20, 3.0), (30, 1.0)]], "clip_id int, frame int, v double")
    assert rows(fold.fold_kept(s, ["clip_id"], ["frame"], "frame", 22, lambda n, k: n["v"] > k["v"], ["frame", "v"]).select("clip_id", "frame"), "frame") == [(1, 0), (1, 30)]


def test_one_euro_leading_nulls_and_persistence(spark):
    s = signal(spark, [None, 1.0, 1.0, None, 1.0]).withColumn("s", F.col("t_ms") / 1000)
    assert [r[1] for r in rows(fold.one_euro(s, ["clip_id"], "frame", "s", "x", None).select("frame", "smooth"), "frame")] == [None, 1.0, 1.0, 1.0, 1.0]


def test_keyframe_accuracy_exact_and_shifted(spark):
    lab = spark.createDataFrame([("a", "FH", 30, 42, 30, True)], "clip_id string, stroke_type string, fps int, impact_frame int, backswing_peak_frame int, usable boolean")
    for shift, want in ((0.0, 1.0), (5 * 1000 / 30, 0.0)):
        p = spark.createDataFrame([("a", "impact", True, 1400.0 + shift), ("a", "backswing_peak", True, 1000.0 + shift)], "clip_id string, keyframe string, detected boolean, timestamp_ms double")
        total = evaluation.keyframe_accuracy(evaluation.keyframe_errors(lab, p, 1)).filter("stroke_type is null").first()
        assert (total.n, total.accuracy) == (2, want)


def test_agreement_and_spotting(spark):
    lab = spark.createDataFrame([("t", 1, 41, 34), ("t", 2, 42, 30)], "task string, o int, impact int, backswing int")
    got = {r.column: r.agreement for r in evaluation.agreement(lab, "task", "o", ["impact", "backswing"], 1).collect()}
    assert got == {"impact": 1.0, "backswing": 0.0}
    truth = spark.createDataFrame([("s", 12.4, 15.1), ("s", 30.0, 33.0)], "k string, start double, end double")
    found = spark.createDataFrame([("s", 13.8), ("s", 99.0)], "k string, at double")
    r = evaluation.spotting(truth, found, ["k"], 4.0).first()
    assert (r.recall, r.precision) == (0.5, 0.5)


def test_uncrop(spark):
    x, y = B.uncrop(F.lit(0.5), F.lit(0.5), F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(300.0), F.lit(960.0), F.lit(540.0))
    assert one(spark, x * 960) == pytest.approx(200) and one(spark, y * 540) == pytest.approx(200)


def test_height_and_confidence(spark):
    assert one(spark, B.height_cm(F.lit(1.75 * 900 / 8), F.lit(8.0), F.lit(900.0))) == pytest.approx(175.0, abs=1e-6)
    assert one(spark, B.height_cm(F.lit(1.0), F.lit(8.0), F.lit(900.0))) is None


def test_projection(spark):
    p = lambda x, z, y: [one(spark, c) for c in court.project(F.lit(x), F.lit(y), F.lit(z), F.lit(1.5), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(800.0), 480.0, 270.0)[:2]]
    assert p(0.0, 10.0, 1.5) == pytest.approx([480, 270])
    assert p(0.0, -10.0, 1.5) == [None, None]


def test_homography_from_four_points(spark):
    pts = [("c", 150.0, 500.0, -4.115, 0.0), ("c", 810.0, 500.0, 4.115, 0.0), ("c", 330.0, 260.0, -4.115, 11.885), ("c", 630.0, 260.0, 4.115, 11.885)]
    schema = "camera string, u double, v double, x double, z double"
    h = court.ground_homography(spark.createDataFrame(pts, schema), ["camera"]).first()
    for _, u, v, x, z in pts:
        w = h.h20 * u + h.h21 * v + h.h22
        assert ((h.h00 * u + h.h01 * v + h.h02) / w, (h.h10 * u + h.h11 * v + h.h12) / w) == pytest.approx((x, z), abs=1e-5)
    assert court.ground_homography(spark.createDataFrame(pts[:3], schema), ["camera"]).first().h00 is None


def test_focal_from_vanishing_points(spark):
    f = court.focal_from_vanishing_points(F.lit(1480.0), F.lit(270.0), F.lit(-520.0), F.lit(270.0), 480.0, 270.0)
    assert one(spark, f) == pytest.approx(1000.0)
    assert one(spark, court.focal_from_vanishing_points(F.lit(1480.0), F.lit(270.0), F.lit(1480.0), F.lit(270.0), 480.0, 270.0)) is None


def test_matching_and_bystander(spark):
    b = spark.createDataFrame([(1, 0, 0, 100.0, 100.0), (1, 1, 0, 100.0, 100.0), (1, 2, 0, 610.0, 410.0)], "clip_id int, frame int, box_idx long, cx double, cy double")
    assert [r[0] for r in rows(tracks.match_tracks(b, 640.0).select("track_id", "frame"), "frame")] == [0, 0, 1]
    obs = [(1, 1, i, 900.0, 260 + 0.01 * i) for i in range(211)] + [(1, 2, i, 300 + 0.5 * i, 200 + 40 * math.sin(i / 10)) for i in range(100)]
    kept = tracks.moving_tracks(spark.createDataFrame(obs, "clip_id int, track_id int, frame int, cx double, cy double"), 540.0)
    assert [r.track_id for r in kept.collect()] == [2]


def fragments(spark, spec):
    return spark.createDataFrame([(1, t, f, float(x), 300.0) for t, x, a, b in spec for f in range(a, b)], "clip_id int, track_id int, frame int, cx double, cy double")


@pytest.mark.parametrize(
    "spec, want",
    [
        ([(10, 300, 0, 200), (11, 302, 300, 380), (12, 650, 0, 60)], [{10, 11}, {12}]),
        ([(0, 490, 0, 300), (1, 485, 0, 250)], [{0}, {1}]),
        ([(0, 100, 0, 200), (1, 220, 300, 500), (2, 280, 600, 800)], [{0, 1, 2}]),
    ],
)
def test_fragment_clusters(spark, spec, want):
    got: dict = {}
    for r in tracks.cluster_fragments(fragments(spark, spec), 960.0).collect():
        got.setdefault(r.cluster, set()).add(r.track_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_split_boxes_merge(spark):
    schema = "clip_id int, frame int, box_idx int, x double, y double, w double, h double"
    a = spark.createDataFrame([(1, 0, 0, 284.0, 174.0, 24.0, 39.0), (1, 0, 1, 294.0, 209.0, 34.0, 107.0), (1, 1, 0, 100.0, 200.0, 40.0, 100.0), (1, 1, 1, 400.0, 200.0, 40.0, 100.0)], schema)
    assert rows(tracks.merge_boxes(a).groupBy("frame").count(), "frame") == [(0, 1), (1, 2)]


def test_static_clip_is_discarded(spark):
    p = spark.createDataFrame([(1, f, f * 1000 / 30, lm, 0.5, 0.5, 0.0, 0.9) for f in range(30) for lm in poses.USED], "clip_id int, frame int, t_ms double, lm_id int, x double, y double, z double, vis double")
    f = poses.wide(p)
    t = poses.tracked(f)
    r = poses.stroke_root(poses.keyframes(t), poses.confidence_block(t), poses.quality(f)).first()
    assert (r.status, r.action, r.is_clean) == ("failed", "discard", False)


def test_keyframes_need_one_shuffle(spark, small_dir):
    """Beyond the dealing by clip (and what the view itself needs) nothing is exchanged."""
    from motionlake.sources.adapters import view

    pose = view(spark, small_dir, "pose")
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    base, f = count(pose), poses.wide(pose)
    t = poses.tracked(f)
    assert count(poses.keyframes(t)) <= base + 1 and count(poses.classify(t)) <= base + 1


def test_trend_needs_equal_ends_to_be_volatile(spark):
    cases = {1: [10, 10, 12, 12, 10, 10], 2: [10, 10, 12, 12, 12, 12], 3: [10, 10, 10.1, 10.1, 10.2, 10.2], 4: [10, 10, 20, 20, 9, 9], 5: [10, 20]}
    rows_ = [(s, i, True, float(v)) for s, vs in cases.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows_, "session_id int, stroke_index int, is_clean boolean, v double")
    assert rows(sessions.trend(df, "v", True).select("session_id", "trend"), "session_id") == [(1, "volatile"), (2, "improving"), (3, "stable"), (4, "declining"), (5, "stable")]


def test_poor_sessions_go_to_the_coach(spark):
    schema = "session_id int, stroke_index int, stroke_type string, is_clean boolean, shoulder_deg double, tempo double, recovery_ms double, split_step boolean, confidence double"
    good = [(1, i, "FH", i > 0, 50.0, 2.0, 900.0, True, 0.99 if i == 0 else 0.9) for i in range(6)]
    tired = [(2, i, "BH", True, 50.0 - 6 * i, 2.0, 900.0 + 200 * i, None, 0.9) for i in range(6)]
    got = {r.session_id: r for r in sessions.summary_block(spark.createDataFrame(good + tired, schema)).collect()}
    assert (got[1].quality, got[1].coach_flag, got[1].highlight, got[1].primary_issue) == ("excellent", False, 1, None)
    assert (got[2].quality, got[2].coach_flag, got[2].primary_issue, got[2].fatigue_onset) == ("poor", True, "shoulder_deg", 4)


def test_label_file_round_trip(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿" + ",".join(files.STROKE_LABEL_COLUMNS) + "\n clips/a.mp4 ,FH,R,,1,,,41.9,,true,,,FALSE,a; b,x,\n", encoding="utf-8")
    r = files.read_stroke_labels(spark, str(tmp_path / "l.csv")).first()
    assert (r.clip_path, r.fps, r.impact_frame, r.usable, r.ready_restored, list(r.issues), r.unit_turn_frame) == ("clips/a.mp4", 30.0, 41, False, True, ["a", "b"], None)


def test_prediction_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text('{"strokes": [{"stroke_metadata": {"stroke_type": "FH"}, "keyframes": []}]}')
    (tmp_path / "batch_summary.json").write_text('{"strokes": [{}]}')
    (tmp_path / "bad.json").write_text("{")
    assert [(r.clip, r.stroke_type) for r in files.read_predictions(spark, str(tmp_path)).collect()] == [("sub/a", "FH")]


def test_ball_file_last_duplicate_wins(spark, tmp_path):
    (tmp_path / "b.csv").write_text("frame,x,y,confidence\n0,1,1,\n2,5,5,0.2\n3,7,7,0.9\n3,8,8,0.9\n")
    assert rows(files.read_ball_csv(spark, str(tmp_path / "b.csv")).select("frame", "x"), "frame") == [(0, 1.0), (1, None), (2, None), (3, 8.0)]


def test_keyed_write_does_not_duplicate(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "clip_id string, v int")
    sinks.write_keyed(a, str(tmp_path / "t"), "clip_id")
    sinks.write_keyed(a.filter("clip_id = 'a'"), str(tmp_path / "t"), "clip_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_unknown_stroke_type_raises(spark):
    s = spark.createDataFrame([("s", "XX", 1.0)], "stroke_id string, stroke_type string, tempo double")
    k = spark.createDataFrame([("s", "impact", 1, 2.0)], "stroke_id string, name string, frame_index int, timestamp_ms double")
    o = spark.createDataFrame([("s", 0, 0.0)], "stroke_id string, frame_offset int, offset_ms double")
    with pytest.raises(Exception, match="unknown stroke type"):
        sinks.stroke_documents(s, k, o).collect()


def test_streaming_matcher_equals_batch(spark, small_dir):
    from motionlake.plans import streams, tracking

    assert rows(streams.st2_stream_match_tracks(spark, small_dir), "box_idx") == rows(tracking.st2_match_tracks(spark, small_dir), "box_idx")


def test_band_join_has_no_nested_loop(spark, small_dir):
    from motionlake.plans.joins import jn4_band_semi

    plan = jn4_band_semi(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins is not None


def test_evaluation_job(spark, tmp_path):
    from motionlake import cli

    (tmp_path / "p" / "clips").mkdir(parents=True)
    (tmp_path / "p" / "clips" / "a.json").write_text('{"strokes": [{"stroke_metadata": {"stroke_type": "FH"}, "keyframes": [{"name": "impact", "frame_index": 42, "timestamp_ms": 1400.0, "detected": true}]}]}')
    (tmp_path / "l.csv").write_text(",".join(files.STROKE_LABEL_COLUMNS) + "\nclips/a.mp4,FH,R,30,1,,,42,,,,,,,x,\n")
    cli.run(spark, ["evaluate", "--labels", str(tmp_path / "l.csv"), "--predictions", str(tmp_path / "p"), "--out", str(tmp_path / "o")])
    r = spark.read.parquet(str(tmp_path / "o" / "accuracy")).filter("keyframe = 'impact'").first()
    assert (r.n, r.accuracy) == (1, 1.0)


def test_occlusion_fill_bounds(spark):
    from motionlake.operators import occlusion

    vis = lambda f: 0.1 if 20 <= f < 30 else 0.9
    rows_ = [(1, f, lm, 0.5 + 0.01 * f if lm == 13 else 0.6 + 0.01 * f, 0.5, vis(f) if lm == 15 else 0.9) for f in range(60) for lm in (13, 15)]
    p = spark.createDataFrame([(c, f, lm, x + (0.3 if lm == 15 and 20 <= f < 30 else 0.0), y, v) for c, f, lm, x, y, v in rows_], "clip_id int, frame int, lm_id int, x double, y double, vis double")
    got = {r.frame: r for r in occlusion.fill(p).collect()}
    assert all(abs(got[f].x - (0.6 + 0.01 * f)) < 1e-6 and got[f].filled for f in range(20, 30)) and not got[5].filled
    start = occlusion.fill(p.withColumn("vis", F.when((F.col("lm_id") == 15) & (F.col("frame") < 5), 0.1).otherwise(F.col("vis")))).filter("frame < 5 and filled").count()
    assert start == 0


def test_a_stream_runs_in_several_batches(spark, tmp_path):
    """State is carried over micro-batches: the folder of each batch is there, and the filter equals the one over all rows at once."""
    from motionlake.streaming import jobs

    points = spark.createDataFrame([(c, f, f / 30, float((f * 7 + c) % 11)) for c in (1, 2) for f in range(60)], "clip_id long, frame long, t_s double, x double")
    whole = jobs.Arrivals(points, str(tmp_path / "one"), "frame", 1)
    whole.add(0)
    parts = jobs.Arrivals(points, str(tmp_path / "three"), "frame", 3)
    for k in range(3):
        parts.add(k)
    a = jobs.run_available(jobs.one_euro(whole.stream()), str(tmp_path / "a"))
    b = jobs.run_available(jobs.one_euro(parts.stream()), str(tmp_path / "b"))
    key = lambda df: sorted((r.clip_id, r.frame, round(r.smooth, 9)) for r in df.collect())
    assert key(a) == key(b) and len(list((tmp_path / "b" / "rows").glob("batch=*"))) >= 3
