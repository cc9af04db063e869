"""Vanishing points of a picture's line segments by votes in cells of direction space.

A candidate is where the lines through two segments meet; its votes are the segments that point at it within a few degrees.
Looking at every candidate with every segment is cubic. Here the space of candidates, the plane with its line at infinity,
is the surface of a half cube whose square cells stay bounded. Seen from a segment's middle a cell covers a range of
directions, so the segment surely votes for all of the cell, for none of it, or is open; sure and open votes bound what any
candidate in the cell can get. Cells are opened best bound first and cut in four; only where few pairs of lines or few open votes
are left the candidates are made and counted exactly. A cell whose bound is below the best count is never opened.
The winner is that of the exhaustive count, ties to the smaller pair.

A picture is one group: its segments are what a detector finds in one frame.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Names = list[str]
SMALL = 48
#: Votes that are counted at once.
WORK = 1 << 21
DEEPEST = 26
PARALLEL, SLACK = 1e-6, 1e-9


def _gap(own: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Difference of directions modulo pi, at most pi / 2."""
    t = np.abs(own - to)
    t -= np.floor(t / math.pi) * math.pi
    return np.minimum(t, math.pi - t)


class _Picture:
    """Segments x1, y1, x2, y2 in the order of their ids."""

    def __init__(self, segs: np.ndarray, ids: np.ndarray, degrees: float):
        at = np.argsort(ids, kind="stable")
        self.segs, self.ids, self.limit = segs[at], ids[at], math.radians(degrees)
        x1, y1, x2, y2 = self.segs.T
        self.x, self.y, self.dx, self.dy = x1, y1, x2 - x1, y2 - y1
        self.mx, self.my, self.own = (x1 + x2) / 2, (y1 + y2) / 2, np.arctan2(y2 - y1, x2 - x1)

    def pairs(self, which: np.ndarray):
        """Places of every two of ``which`` whose lines meet, and where."""
        i, j = np.triu_indices(len(which), 1)
        i, j = which[i], which[j]
        det = self.dx[i] * self.dy[j] - self.dy[i] * self.dx[j]
        meet = np.abs(det) > PARALLEL
        i, j, det = i[meet], j[meet], det[meet]
        t = ((self.x[j] - self.x[i]) * self.dy[j] - (self.y[j] - self.y[i]) * self.dx[j]) / det
        return i, j, self.x[i] + t * self.dx[i], self.y[i] + t * self.dy[i]

    def votes(self, x: np.ndarray, y: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if len(which):
            step = max(1, WORK // len(which))
            for k in range(0, len(x), step):
                to = np.arctan2(y[k : k + step, None] - self.my[which], x[k : k + step, None] - self.mx[which])
                out[k : k + step] = (_gap(self.own[which], to) <= self.limit).sum(axis=1)
        return out

    def best(self):
        """(votes, a, b, x, y) of the winner; None without two lines that meet."""
        everyone = np.arange(len(self.ids))
        if len(everyone) < 2:
            return None
        if len(everyone) <= SMALL:
            return self._count(None, everyone, 0, everyone, None)
        return self._search(everyone)

    def _count(self, best, which, sure, open_, inside):
        i, j, x, y = self.pairs(which)
        if inside is not None:
            keep = inside(x, y)
            i, j, x, y = i[keep], j[keep], x[keep], y[keep]
        if not len(i):
            return best
        votes = sure + self.votes(x, y, open_)
        k = np.lexsort((j, i, -votes))[0]
        found = (int(votes[k]), int(i[k]), int(j[k]), float(x[k]), float(y[k]))
        return found if best is None or (-found[0], found[1], found[2]) < (-best[0], best[1], best[2]) else best

    def _search(self, everyone):
        cx, cy = self.mx.mean(), self.my.mean()
        f = max(np.abs(self.mx - cx).max(), np.abs(self.my - cy).max(), 1e-9)
        mx, my = (self.mx - cx) / f, (self.my - cy) / f
        ux, uy = np.cos(self.own), np.sin(self.own)

        def corners(face, box):
            p0, p1, q0, q1 = box
            grid = [(p, q) for p in (p0, p1) for q in (q0, q1)]
            return np.array([{0: (p, q, 1.0), 1: (1.0, p, q), 2: (p, 1.0, q)}[face] for p, q in grid])

        def split(face, box, sure, open_, crossing):
            """(sure votes, open segments, segments whose lines cross the cell) inside a cell of its parent's lists."""
            which = np.union1d(open_, crossing)
            c = corners(face, box)
            # the direction from a segment's middle to a point of the cell is linear in the point
            vx = c[:, 0] - c[:, 2] * mx[which, None]
            vy = c[:, 1] - c[:, 2] * my[which, None]
            wx, wy = vx.mean(axis=1), vy.mean(axis=1)
            ahead = vx * wx[:, None] + vy * wy[:, None]
            turn = np.arctan2(wx[:, None] * vy - wy[:, None] * vx, ahead)
            middle = np.arctan2(ux[which] * wy - uy[which] * wx, ux[which] * wx + uy[which] * wy)
            middle -= math.pi * np.round(middle / math.pi)
            lo, hi = middle + turn.min(axis=1) - SLACK, middle + turn.max(axis=1) + SLACK
            narrow = (ahead > 0).all(axis=1)  # else the cell may surround the middle: any direction
            touch = lambda t: ~narrow | ((lo <= t) & (hi >= -t)) | (hi >= math.pi - t) | (lo <= t - math.pi)
            inside = narrow & (lo >= -self.limit) & (hi <= self.limit)
            was_open = np.isin(which, open_, assume_unique=True)
            return sure + int((inside & was_open).sum()), which[touch(self.limit) & ~inside & was_open], which[touch(0.0) & np.isin(which, crossing, assume_unique=True)]

        def within(face, box):
            p0, p1, q0, q1 = box

            def test(x, y):
                px, py = (x - cx) / f, (y - cy) / f
                with np.errstate(divide="ignore", invalid="ignore"):
                    p, q = ((px, py), (py / px, 1 / px), (px / py, 1 / py))[face]
                e = 1e-9
                return (p >= p0 - e) & (p <= p1 + e) & (q >= q0 - e) & (q <= q1 + e)

            return test

        heap, best, serial = [], None, 0

        def push(face, box, depth, lists):
            nonlocal serial
            sure, open_, crossing = split(face, box, *lists)
            if len(crossing) >= 2:
                serial += 1
                heapq.heappush(heap, (-(sure + len(open_)), serial, face, box, depth, (sure, open_, crossing)))

        for face, box in ((0, (-1, 1, -1, 1)), (1, (-1, 1, -1, 0)), (1, (-1, 1, 0, 1)), (2, (-1, 1, -1, 0)), (2, (-1, 1, 0, 1))):
            push(face, box, 0, (0, everyone, everyone))
        while heap:
            bound, _, face, box, depth, (sure, open_, crossing) = heapq.heappop(heap)
            if best is not None and (bound > -best[0] or bound == -best[0] and (crossing[0], crossing[1]) >= best[1:3]):
                if bound > -best[0]:
                    break
                continue
            work = len(crossing) * (len(crossing) - 1) // 2 * (len(open_) + 1)
            if work <= WORK // 16 or depth == DEEPEST:
                best = self._count(best, crossing, sure, open_, within(face, box))
                continue
            p0, p1, q0, q1 = box
            p, q = (p0 + p1) / 2, (q0 + q1) / 2
            for part in ((p0, p, q0, q), (p, p1, q0, q), (p0, p, q, q1), (p, p1, q, q1)):
                push(face, part, depth + 1, (sure, open_, crossing))
        return best


def strongest(segs: np.ndarray, ids: np.ndarray, degrees: float, least: int) -> tuple | None:
    """(votes, x, y, mask of the segments that vote) of the strongest vanishing point; None under ``least`` votes."""
    picture = _Picture(segs, ids, degrees)
    best = picture.best()
    if best is None or best[0] < least:
        return None
    to = np.arctan2(best[4] - (segs[:, 1] + segs[:, 3]) / 2, best[3] - (segs[:, 0] + segs[:, 2]) / 2)
    mine = _gap(np.arctan2(segs[:, 3] - segs[:, 1], segs[:, 2] - segs[:, 0]), to) <= picture.limit
    return best[0], best[3], best[4], mine


RESULT = "x_1 double, y_1 double, inliers_1 long, x_2 double, y_2 double, inliers_2 long, pairs long, n long, spread double"


def two_vanishing_points(segs: DataFrame, keys: Names, degrees: float = 5.0, least: int = 3, cx: float = 480.0, cy: float = 270.0) -> DataFrame:
    """The two strongest vanishing points per key, the second among the segments the first leaves: ``x_1, y_1, inliers_1, x_2, ...``, and
    how far the focal length follows from single pairs: ``pairs`` of the first point's segments, ``n`` focal lengths they give with the second
    point, ``spread``: their standard deviation over their mean. Keys without two points give no row.

    ``segs``: keys, seg_id, x1, y1, x2, y2; segments with a missing coordinate are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in segs.schema.fields}
    columns = ["x1", "y1", "x2", "y2"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns)
        ends, ids = pdf[columns].to_numpy(float), pdf["seg_id"].to_numpy()
        first = strongest(ends, ids, degrees, least)
        second = first and strongest(ends[~first[3]], ids[~first[3]], degrees, least)
        if not second:
            return pd.DataFrame(columns=names)
        picture = _Picture(ends[first[3]], ids[first[3]], degrees)
        _, _, x, y = picture.pairs(np.arange(len(picture.ids)))
        r = -((x - cx) * (second[1] - cx) + (y - cy) * (second[2] - cy))
        f = np.sqrt(r[r > 0])
        spread = float(f.std() / max(f.mean(), 1e-6)) if len(f) else None
        k = len(picture.ids)
        return pd.DataFrame([(*key, first[1], first[2], first[0], second[1], second[2], second[0], k * (k - 1) // 2, len(f), spread)], columns=names)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), RESULT])
    names = [*keys, *(c.split()[0] for c in RESULT.split(", "))]
    return segs.select(*keys, "seg_id", *columns).groupBy(*keys).applyInPandas(run, schema)
