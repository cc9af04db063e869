"""Queries on pairs take every two tracks or boxes of ten clips that grow with the table, held against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest

from motionlake import catalog

TYPES = ("view", "click", "signup", "purchase", "error")


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """(folder, boxes): 500 events of 120 users in nine hours, and the boxes that they stand for."""
    rng = np.random.default_rng(3)
    hours = (0, 1, 2, 3, 4, 5, 245, 246, 300)
    rows, boxes = [], []
    for key in range(500):
        user, hour, kind, value, k = int(rng.integers(0, 120)), int(rng.choice(hours)), TYPES[rng.integers(0, 5)], round(float(rng.random() * 100), 2), int(rng.integers(0, 100))
        rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, seconds=key), user, kind, value, f'{{"k": {k}}}'))
        x, y, w, h = value * 2 % 960, k * 5.4, 10 + k % 7, 20 + k % 11
        boxes.append({"clip": user % 10, "frame": hour, "track": user, "class": {"view": "ball", "click": "ball", "signup": "racket"}.get(kind, "person"), "x": x, "y": y, "w": w, "h": h, "cx": x + w / 2, "cy": y + h / 2, "key": key})
    folder = tmp_path_factory.mktemp("crowd")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder), boxes


def rows_of(spark, crowd, name, *columns):
    """The query's rows, which are those of its SQL as well."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{crowd[0]}/events.parquet/*.parquet'")
    got = [tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, crowd[0]).collect()]
    by_sql = con.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert rounded(by_sql) == rounded(got)
    return rounded(got)


def rounded(rows):
    return sorted(tuple(round(round(v, 6), 5) if isinstance(v, float) else v for v in r) for r in rows)


def grouped(boxes, *names):
    out: dict = {}
    for b in boxes:
        out.setdefault(tuple(b[n] for n in names), []).append(b)
    return out


def test_jn11_takes_the_fragments_of_crowded_clips(spark, crowd):
    parts = grouped([b | {"part": b["track"] * 10 + b["frame"] // 240} for b in crowd[1]], "clip", "part")
    ends = {k: (min(v, key=lambda b: (b["frame"], b["key"])), max(v, key=lambda b: (b["frame"], b["key"]))) for k, v in parts.items()}
    want = []
    for (clip, a), (_, end) in ends.items():
        for (other, b), (start, _) in ends.items():
            gap, far = start["frame"] - end["frame"], math.hypot(end["cx"] - start["cx"], end["cy"] - start["cy"])
            if clip == other and a != b and 0 < gap < 120 and far < 378:
                want.append((clip, a, b, gap / 2, far + gap * 378 / 120))
    assert rows_of(spark, crowd, "jn11_fragment_pairs", "clip_id", "a", "b", "gap_s", "score") == rounded(want)


def test_jn12_takes_the_tracks_of_crowded_clips(spark, crowd):
    tracks = {k: (np.mean([b["cx"] for b in v]), np.mean([b["cy"] for b in v]), {b["frame"] for b in v}) for k, v in grouped(crowd[1], "clip", "track").items()}
    want = []
    for (clip, a), (ax, ay, af) in tracks.items():
        for (other, b), (bx, by, bf) in tracks.items():
            far, overlap = math.hypot(ax - bx, ay - by), len(af & bf) / min(len(af), len(bf))
            if clip == other and a < b and far < 60 and overlap <= 0.05:
                want.append((clip, a, b, float(far), overlap))
    assert rows_of(spark, crowd, "jn12_overlap_pairs", "clip_id", "a", "b", "distance", "overlap") == rounded(want)


def test_jn13_takes_the_boxes_of_crowded_frames(spark, crowd):
    want = []
    for (clip, frame), frame_boxes in grouped([b | {"w": b["w"] * 5, "h": b["h"] * 3} for b in crowd[1]], "clip", "frame").items():
        for a in frame_boxes:
            for b in frame_boxes:
                over = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
                gap = max(a["y"], b["y"]) - min(a["y"] + a["h"], b["y"] + b["h"])
                if a["key"] < b["key"] and over > 0 and gap <= 0.3 * min(a["h"], b["h"]):
                    want.append((clip, frame, a["key"], b["key"]))
    assert rows_of(spark, crowd, "jn13_box_merge_pairs", "clip_id", "frame", "a", "b") == rounded(want)


def test_jn9_takes_the_boxes_of_crowded_frames(spark, crowd):
    want = []
    for (clip, frame), frame_boxes in grouped(crowd[1], "clip", "frame").items():
        tracks: dict = {}
        for b in frame_boxes:
            if b["class"] != "ball":
                tracks[b["track"]] = min(tracks.get(b["track"], b), b, key=lambda b: b["key"])
        near = [(math.hypot(b["cx"] - t["cx"], b["cy"] - t["cy"]), b["key"], track) for b in frame_boxes if b["class"] == "ball" for track, t in tracks.items()]
        near = [n for n in near if n[0] <= 115.2]
        for d, key, track in near:
            if (d, track) == min((e, t) for e, k, t in near if k == key) and (d, key) == min((e, k) for e, k, t in near if t == track):
                want.append((clip, frame, key, track, d))
    assert rows_of(spark, crowd, "jn9_mutual_nearest", "clip_id", "frame", "box_idx", "track_id", "d") == rounded(want)


def test_so1_takes_the_tracks_of_crowded_clips(spark, crowd):
    tracks = {k: {b["frame"] for b in v} for k, v in grouped(crowd[1], "clip", "track").items()}
    want = [(clip, a, b, len(f & g), len(f | g)) for (clip, a), f in tracks.items() for (other, b), g in tracks.items() if clip == other and a < b]
    assert rows_of(spark, crowd, "so1_frame_overlap", "clip_id", "a", "b", "shared", "either") == rounded(want)


def test_sc4_takes_the_boxes_of_crowded_frames(spark, crowd):
    want = []
    for frame_boxes in grouped(crowd[1], "clip", "frame").values():
        for a in frame_boxes:
            for b in frame_boxes:
                if a["key"] < b["key"]:
                    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
                    want.append((a["key"], b["key"], x, y, max(a["x"] + a["w"], b["x"] + b["w"]) - x, max(a["y"] + a["h"], b["y"] + b["h"]) - y))
    assert rows_of(spark, crowd, "sc4_union_boxes", "box_key_a", "box_key_b", "x", "y", "w", "h") == rounded(want)
