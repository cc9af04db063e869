"""Work of the jobs that must not grow with tables beside the poses or with the weights of a filter."""

import numpy as np

from motionlake.operators import jobs, series


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_balls_of_posed_clips_are_interpolated(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(1, f, f * 1000 / 60, lm, *map(float, rng.random(3)), 0.9) for f in range(40) for lm in range(33)]
    pose = spark.createDataFrame(rows, "clip_id int, frame int, t_ms double, lm_id int, x double, y double, z double, vis double")
    ball = spark.createDataFrame([(c, float(t), t / 10, 1.0) for c in range(1, 30) for t in range(0, 600, 20)], "clip_id int, t_ms double, x double, y double")
    seen, inner = [], series.interpolate_at
    monkeypatch.setattr(series, "interpolate_at", lambda df, keys, t, values, grid: seen.append((values, df)) or inner(df, keys, t, values, grid))
    done = jobs.stroke_job(pose, ball=ball).collect()
    assert len(done) == 1 and {m.value for m in done[0].metrics if m.metric == "tracked_fraction"} == {1.0}
    balls = [df for values, df in seen if values == ["x", "y"]]
    assert len(balls) == 1 and {r.clip_id for r in balls[0].collect()} == {1}


def test_windows_of_all_values_share_their_sorts(spark):
    values = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0, None, 4.0), (1, 50.0, 3.0, None, 5.0, 8.0), (1, 100.0, 5.0, 6.0, 7.0, None)], "k int, t double, a double, b double, c double, d double")
    grid = spark.createDataFrame([(1, 25.0, 0), (1, 75.0, 1), (1, 100.0, 2)], "k int, t double, grid int")
    got = series.interpolate_at(df, ["k"], "t", values, grid)
    assert [(r.a, r.b, r.c, r.d) for r in got.sort("grid").collect()] == [(2.0, 3.0, 5.0, 6.0), (4.0, 5.0, 6.0, 8.0), (5.0, 6.0, 7.0, None)]
    assert plan(got).count("Window [") <= 4


def test_a_neighbour_is_looked_up_once(spark):
    df = spark.createDataFrame([(1, f, float(f * f)) for f in range(30)], "k int, f int, x double")
    got = series.savgol(df, ["k"], ["f"], "x", "s", 11)
    assert np.allclose([r.s for r in got.sort("f").collect()], [f * f for f in range(30)])
    assert plan(got).count("lag(") + plan(got).count("lead(") <= 20
