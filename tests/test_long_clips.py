"""Scans of long clips in pieces against plain whole-clip versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from motionlake.operators import fold, hits, scan, tracks, vanishing


def walk(seed, clips=3, frames=400, gap=40):
    """Boxes of a few wandering objects, with pauses short and long; a clip without a name among them."""
    rng, rows, box = random.Random(seed), [], 0
    for clip in [*range(clips - 1), None]:
        places, frame = [(rng.uniform(0, 900), rng.uniform(0, 500)) for _ in range(3)], 0
        while frame < frames:
            for k, (x, y) in enumerate(places):
                places[k] = x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)
                if rng.random() < 0.6:
                    rows.append((clip, frame, box, *places[k]))
                    box += 1
            frame += rng.choice([1, 1, 1, 1, 2, 3, 12, gap])
    rng.shuffle(rows)
    return rows


BOXES = "clip_id int, frame int, box_idx long, x double, y double"


def test_tracks_of_islands_are_those_of_the_clip(spark):
    rows = walk(1)
    got = tracks.match_tracks(spark.createDataFrame(rows, BOXES).withColumnsRenamed({"x": "cx", "y": "cy"}), 960.0, chunk=64)
    want = []
    for clip in {r[0] for r in rows}:
        m = tracks.Matcher(960.0 * 0.12, 15)
        own = sorted(r[1:] for r in rows if r[0] == clip)
        for frame in sorted({r[0] for r in own}):
            want += [(clip, *r) for r in m.frame(frame, [r[1:] for r in own if r[0] == frame])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    islands = scan.islands(spark.createDataFrame(rows, BOXES), ["clip_id"], "frame", "box_idx", 15, chunk=64).groupBy("clip_id").agg({"island": "max"}).collect()
    assert all(r[1] > 3 for r in islands)


def plain_kalman(rows, gate, coast, q=1e-2, r=5.0):
    out, state, missed = [], None, 0
    per = {}
    for frame, _, x, y in sorted(rows):
        per.setdefault(frame, []).append((x, y))
    for frame in range(min(per), max(per) + 1):
        if state is not None:
            (x, y, vx, vy), (a, b, c) = state
            state = (x + vx, y + vy, vx, vy), (a + 2 * b + c + q, b + c, c + q)
        seen = per.get(frame)
        if state is None:
            if seen:
                state, missed = ((*seen[0], 0.0, 0.0), (0.0, 0.0, 0.0)), 0
                out.append((frame, *seen[0], False))
            continue
        (x, y, vx, vy), (a, b, c) = state
        near = min(seen, key=lambda p: math.hypot(p[0] - x, p[1] - y)) if seen else None
        if near is None or math.hypot(near[0] - x, near[1] - y) > gate:
            missed += 1
            if missed > coast:
                state = None
                continue
        else:
            k1, k2, dx, dy = a / (a + r), b / (a + r), near[0] - x, near[1] - y
            state, missed = ((x + k1 * dx, y + k1 * dy, vx + k2 * dx, vy + k2 * dy), ((1 - k1) * a, (1 - k1) * b, c - k2 * b)), 0
            out.append((frame, *state[0][:2], False))
            continue
        out.append((frame, x, y, True))
    return out


@pytest.mark.parametrize("coast", [5, 30])
def test_kalman_chain_of_islands(spark, coast):
    rows = walk(2)
    got = hits.kalman_chain(spark.createDataFrame(rows, BOXES), 60.0, coast, chunk=64).collect()
    want = [(clip, *o) for clip in {r[0] for r in rows} for o in plain_kalman([r[1:] for r in rows if r[0] == clip], 60.0, coast)]
    form = lambda r: (str(r[0]), r[1], round(r[2], 6), round(r[3], 6), r[4])
    assert sorted(map(form, got)) == sorted(map(form, want)) and any(r[4] for r in want)


def test_nearest_chain_of_islands(spark):
    rows = walk(3)
    got = hits.nearest_chain(spark.createDataFrame(rows, BOXES), 60.0, chunk=32).collect()
    want = []
    for clip in {r[0] for r in rows}:
        own, point = sorted(r[1:] for r in rows if r[0] == clip), None
        for frame in sorted({r[0] for r in own}):
            here = [r[2:] for r in own if r[0] == frame]
            near = min(here, key=lambda p: math.dist(p, point)) if point else None
            point = near if near and math.dist(near, point) <= 60.0 else here[0]
            want.append((clip, frame, *point))
    form = lambda r: (str(r[0]), r[1], round(r[2], 6), round(r[3], 6))
    assert sorted(map(form, got)) == sorted(map(form, want))


def test_exact_leader_clusters(spark):
    rng = random.Random(4)
    rows = [(c, f, i, rng.choice((100, 130, 155, 300)) + rng.gauss(0, 9), 50 + rng.gauss(0, 9)) for c in (1, 2) for f in range(40) for i in range(rng.randint(0, 3))]
    obs = spark.createDataFrame(rows, BOXES).withColumnsRenamed({"x": "cx", "y": "cy"})
    want, drop = [], set()
    for clip in (1, 2):
        groups = []
        for r in sorted(r for r in rows if r[0] == clip):
            c = next((k for k, g in enumerate(groups) if math.hypot(r[3] - sum(p[3] for p in g) / len(g), r[4] - sum(p[4] for p in g) / len(g)) < 20), len(groups))
            groups[c:] = groups[c:] or [[]]
            groups[c].append(r)
            want.append((*r[:3], c))
        drop |= {p[:3] for g in groups if max(p[1] for p in g) - min(p[1] for p in g) + 1 >= 15 and len(g) >= 7.5 for p in g}
    assert sorted(tuple(r) for r in tracks.leader_clusters(obs).collect()) == sorted(want)
    kept = {tuple(r)[:3] for r in tracks.drop_stationary_exact(obs).select("clip_id", "frame", "box_idx").collect()}
    assert kept == {r[:3] for r in rows} - drop and drop and kept
    # fifteen frames from first to last are a span of fifteen
    still = spark.createDataFrame([(1, f, f, 5.0, 5.0) for f in range(15)], BOXES).withColumnsRenamed({"x": "cx", "y": "cy"})
    assert tracks.drop_stationary(still).count() == 0 and tracks.drop_stationary_exact(still).count() == 0 and tracks.drop_stationary_exact(still.filter("frame > 0")).count() == 14


def test_fragment_clusters(spark):
    rng = random.Random(5)
    rows = []
    for t in range(14):
        start, x, y = rng.randrange(0, 200), rng.choice((100, 160, 500)), 200
        rows += [(1, t, start + f, x + rng.gauss(0, 20), y + rng.gauss(0, 20)) for f in range(rng.randint(5, 60)) if rng.random() < 0.8]
    obs = spark.createDataFrame(rows, "clip_id int, track_id int, frame int, cx double, cy double")
    got = {r.track_id: r.cluster for r in tracks.cluster_fragments(obs, 960.0, 0.15, 0.2, 4).collect()}
    per = {}
    for _, t, f, x, y in rows:
        per.setdefault(t, []).append((f, x, y))
    groups = []
    for t, own in sorted(per.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        frames = {p[0] for p in own}
        for g in groups:
            all_ = [p for k in g for p in per[k]]
            seen = {p[0] for p in all_}
            d = math.hypot(*(np.mean([p[i] for p in own]) - np.mean([p[i] for p in all_]) for i in (1, 2)))
            if d < 0.15 * 960 and len(frames & seen) <= 0.2 * min(len(frames), len(seen)):
                g.append(t)
                break
        else:
            groups.append([t])
    groups = sorted(groups, key=lambda g: -sum(len(per[t]) for t in g))[:4]
    assert got == {t: c for c, g in enumerate(groups) for t in g}


def plain_stitch(boxes, fps=30.0, height=540.0):
    """One pair at a time, the best of all that fit in time, place and median height."""
    segs = {t: dict(v) for t, v in boxes.items()}
    chain = {t: [t] for t in segs}
    far, gap = 0.7 * height, int(fps * 60)
    while True:
        best = None
        for i, a in segs.items():
            for j, b in segs.items():
                pause = min(b) - max(a)
                if i == j or not 0 < pause < gap:
                    continue
                hs = sorted(float(np.median([v[2] for v in s.values()])) for s in (a, b))
                d = math.dist(a[max(a)][:2], b[min(b)][:2])
                score = (d + pause * (far / gap), chain[i][-1], chain[j][0], i, j)
                if hs[0] >= 0.5 * hs[1] and d < far and (best is None or score < best):
                    best = score
        if best is None:
            return {t: ids[0] for ids in chain.values() for t in ids}
        i, j = best[3:]
        segs[i].update(segs.pop(j))
        chain[i] += chain.pop(j)


@pytest.mark.parametrize("seed", range(3))
def test_stitching_rounds_are_one_pair_at_a_time(spark, seed):
    """Heights on both sides of the limit, so that joined fragments lose and win partners."""
    rng, rows, clips = random.Random(seed), [], {}
    for clip in (1, 2):
        for t in range(12):
            start, h = rng.randrange(0, 3000), rng.choice((40, 60, 90, 130, 170))
            for f in range(start, start + rng.randint(1, 90)):
                v = (rng.uniform(0, 900), rng.uniform(0, 500), float(h + rng.choice((0, 0, 30))))
                rows.append((clip, t, f, *v))
                clips.setdefault(clip, {}).setdefault(t, {})[f] = v
    obs = spark.createDataFrame(rows, "clip_id int, track_id int, frame int, cx double, cy double, h double")
    got = {(r.clip_id, r.track_id): r.chain for r in tracks.stitch_fragments(obs, 30.0, 540.0).collect()}
    want = {(c, t): k for c, b in clips.items() for t, k in plain_stitch(b).items()}
    assert got == want and len(set(want.items())) > len({(c, k) for (c, _), k in want.items()})


def segments(seed, n, noise):
    """Two bundles of lines through a point each, with angular noise, and strays."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        m, bundle = rng.uniform(0, 900, 2), k % 3
        to = np.arctan2(*(np.array([(-4000.0, 300.0), (500.0, -900.0)][bundle]) - m)[::-1]) + rng.normal(0, noise) if bundle < 2 else rng.uniform(0, np.pi)
        d = np.array([np.cos(to), np.sin(to)]) * rng.uniform(20, 80)
        rows.append([*(m - d), *(m + d)])
    return np.array(rows)


@pytest.mark.parametrize("seed", range(6))
def test_cells_find_the_exhaustive_winner(seed):
    segs = segments(seed, 90, (0.002, 0.05, 0.3)[seed % 3])
    ids = np.random.default_rng(seed).permutation(len(segs))
    p = vanishing._Picture(segs, ids, 5.0)
    assert p._search(np.arange(len(segs))) == p._count(None, np.arange(len(segs)), 0, np.arange(len(segs)), None)


def test_parallel_and_equal_lines():
    flat = np.array([[0.0, y, 100.0, y] for y in range(60)])
    assert vanishing.strongest(flat, np.arange(60), 5.0, 3) is None
    one = vanishing._Picture(np.vstack([np.repeat([[0.0, 0.0, 10.0, 10.0]], 40, axis=0), np.repeat([[0.0, 10.0, 10.0, 0.0]], 40, axis=0)]), np.arange(80), 5.0)
    assert one._search(np.arange(80)) == one._count(None, np.arange(80), 0, np.arange(80), None)


def test_a_picture_of_thousands_of_segments_ends(spark):
    segs = segments(9, 3000, 0.01)
    frame = pd.DataFrame(segs, columns=["x1", "y1", "x2", "y2"]).assign(frame=1, seg_id=range(len(segs)))
    r = vanishing.two_vanishing_points(spark.createDataFrame(frame), ["frame"]).first()
    points = sorted([(r.x_1, r.y_1), (r.x_2, r.y_2)])
    assert r.inliers_1 > 950 and r.inliers_2 > 950 and abs(points[0][1] - 300) < 200 and math.dist(points[1], (500, -900)) < 100


def test_one_euro_is_a_stream(spark):
    """A missing input repeats the last value; missing ones before the first stay missing; keys are apart."""
    rows = [(k, i, i / 10, None if i in (0, 5) else float(i * k)) for k in (1, 2) for i in range(9)]
    got = {(r.k, r.i): r.s for r in fold.one_euro(spark.createDataFrame(rows, "k int, i int, t double, v double"), ["k"], "i", "t", "v", None, out="s").collect()}
    assert got[1, 0] is None and got[1, 1] == 1.0 and got[1, 5] == got[1, 4] and got[2, 1] == 2.0 and 2 < got[2, 3] < 6


def test_a_poisoned_group_is_a_reject(spark):
    rows = [(c, i, float(i) if (c, i) != (2, 3) else None) for c in (1, 2, 3) for i in range(5)]

    def total(pdf):
        if pdf["v"].isna().any():
            raise ValueError("no value")
        return pd.DataFrame({"total": [pdf["v"].sum()]} if pdf["c"].iloc[0] != 3 else {"other": [1]})

    out = scan.guarded(spark.createDataFrame(rows, "c int, i int, v double"), ["c"], total, "total double")
    kept, rejected = scan.kept_and_rejected(out)
    assert [tuple(r) for r in kept.collect()] == [(1, 10.0)]
    assert sorted((r.c, r.error.split(":")[0]) for r in rejected.collect()) == [(2, "ValueError"), (3, "ValueError")]
    with pytest.raises(ValueError, match="no key columns"):
        scan.guarded(spark.createDataFrame(rows, "c int, i int, v double"), ["clip"], total, "total double")
