"""Mutual nearest boxes and tracks of a frame, with many at one place: pairs are held against plain loops and not ranked as a whole."""

import math

import numpy as np

from motionlake.operators import tracks


def test_many_at_one_place(spark):
    rng = np.random.default_rng(11)
    spot = lambda: (float(rng.integers(0, 6)), float(rng.integers(0, 6)))
    boxes = [(1, f, i, *spot()) for f in (0, 1) for i in range(90)]
    owners = [(1, f, i, *spot()) for f in (0, 1) for i in range(70)]
    got = tracks.mutual_nearest(spark.createDataFrame(boxes, "clip_id int, frame int, box_idx int, cx double, cy double"), spark.createDataFrame(owners, "clip_id int, frame int, track_id int, tx double, ty double"), 2.0)
    want = []
    for f in (0, 1):
        near = [(math.hypot(x - u, y - v), b, t) for _, g, b, x, y in boxes for _, h, t, u, v in owners if g == h == f]
        near = [n for n in near if n[0] <= 2.0]
        by_box = {b: min((d, t) for d, k, t in near if k == b)[1] for _, b, _ in near}
        by_track = {t: min((d, b) for d, b, k in near if k == t)[1] for _, _, t in near}
        want += [(f, b, t) for b, t in by_box.items() if by_track[t] == b]
    assert sorted((r.frame, r.box_idx, r.track_id) for r in got.collect()) == sorted(want) and len(want) > 20
    ranked = got._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.count("min(d#") == 2  # least distances first, so that only pairs at one of them are sorted
