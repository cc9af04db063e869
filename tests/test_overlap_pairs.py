"""Pairs of tracks meet by blocks, strips and slices of frames; every cut gives the pairs of plain loops."""

import math

import numpy as np

from motionlake.operators import joins


def tracks(seed, n):
    rng = np.random.default_rng(seed)
    return {int(t): (set(rng.choice(30, rng.integers(1, 9), replace=False).tolist()), float(rng.random() * 10), float(rng.random() * 10)) for t in rng.permutation(n * 3)[:n]}


def plain(rows, near, most):
    return sorted(
        (a, b, round(math.hypot(x - u, y - v), 9), len(f & g) / min(len(f), len(g)))
        for a, (f, x, y) in rows.items() for b, (g, u, v) in rows.items()
        if a < b and math.hypot(x - u, y - v) < near and len(f & g) / min(len(f), len(g)) <= most
    )


def test_strips_and_slices_of_frames(monkeypatch):
    monkeypatch.setattr(joins, "STRIP", 5)
    monkeypatch.setattr(joins, "FRAMES", 4)
    rows = tracks(1, 40)
    side = lambda r: (np.array(list(r)), np.array([v[1] for v in r.values()]), np.array([v[2] for v in r.values()]), np.array([len(v[0]) for v in r.values()]), np.array([f for v in r.values() for f in v[0]]))
    first, second = dict(list(rows.items())[:17]), dict(list(rows.items())[17:])
    got = [joins._meet([side(first), side(first)], 6.0, 0.4, True), joins._meet([side(second), side(second)], 6.0, 0.4, True), joins._meet([side(first), side(second)], 6.0, 0.4, False)]
    assert sorted((int(a), int(b), round(float(d), 9), float(s)) for g in got for a, b, d, s in zip(*g)) == plain(rows, 6.0, 0.4)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 8)
    clips = {1: tracks(2, 30), 2: tracks(3, 5), 3: tracks(4, 1)}
    obs = [(c, t, f, x, y) for c, rows in clips.items() for t, (frames, x, y) in rows.items() for f in frames]
    got = joins.overlap_pairs(spark.createDataFrame(obs, "clip_id int, track_id long, frame int, cx double, cy double"), ["clip_id"], 6.0, 0.4).collect()
    for c, rows in clips.items():
        assert sorted((r.a, r.b, round(r.distance, 9), r.overlap) for r in got if r.clip_id == c) == plain(rows, 6.0, 0.4)
