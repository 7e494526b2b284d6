"""Tracking, camera motion, refinement, detector targets and random views against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import BOX
from trackloom.functions import draws
from trackloom.operators import camera, evaluation, refinement, splat, tracking
from trackloom.operators.camera import ConsensusRule
from trackloom.operators.refinement import RefineRule
from trackloom.operators.tracking import TrackRule

DET = f"clip_id int, frame int, det_ord int, box {BOX}, conf double"


def at(x, y, w=40, h=80):
    return (float(x), float(y), float(x + w), float(y + h))


def ids(spark, rows, rule=TrackRule()):
    df = spark.createDataFrame(rows, DET).repartition(3)
    return {(r.clip_id, r.frame, r.det_ord): r.track_id for r in tracking.track(df, rule).collect()}


def plain_tracks(rows, rule):
    """One clip, a plain dict per track and matrices of eight; contested boxes go to the closest pair first."""

    def iou(a, b):
        w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
        h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
        inter = max(w, 0) * max(h, 0)
        return inter / (a[2] * a[3] + b[2] * b[3] - inter)

    step = np.eye(8)
    step[:4, 4:] = np.eye(4)
    alive, out, n = [], {}, 0
    for frame in range(min(r[1] for r in rows), max(r[1] for r in rows) + 1):
        for t in alive:
            h = max(t["m"][3], 1)
            t["m"] = step @ t["m"]
            t["c"] = step @ t["c"] @ step.T + np.diag([(rule.position * h) ** 2] * 4 + [(rule.velocity * h) ** 2] * 4)
        alive = [t for t in alive if frame - t["seen"] <= rule.keep + 1]
        now = sorted((r for r in rows if r[1] == frame), key=lambda r: r[2])
        box = {r[2]: np.array([(r[3][0] + r[3][2]) / 2, (r[3][1] + r[3][3]) / 2, r[3][2] - r[3][0], r[3][3] - r[3][1]]) for r in now}
        high = [r[2] for r in now if r[4] >= rule.high]
        low = [r[2] for r in now if rule.low <= r[4] < rule.high]
        free = list(alive)
        for some, least in ((high, rule.overlap), (low, rule.low_overlap)):
            pool = free if some is high else [t for t in free if t["seen"] == frame - 1]
            pairs = sorted(((iou(t["m"][:4], box[o]), -t["id"], -o) for t in pool for o in some), reverse=True)
            used = set()
            for v, i, o in pairs:
                t = next((t for t in free if t["id"] == -i), None)
                if v >= least and t and -o not in used:
                    h = max(box[-o][3], 1)
                    s = t["c"][:4, :4] + np.eye(4) * (rule.position * h) ** 2
                    gain = t["c"][:, :4] @ np.linalg.inv(s)
                    t["m"] = t["m"] + gain @ (box[-o] - t["m"][:4])
                    t["c"] = t["c"] - gain @ t["c"][:4]
                    t["seen"] = frame
                    out[0, frame, -o] = t["id"]
                    used.add(-o)
                    free = [x for x in free if x is not t]
        for o in high:
            if (0, frame, o) not in out:
                n += 1
                h = max(box[o][3], 1)
                alive.append({"id": n, "seen": frame, "m": np.r_[box[o], np.zeros(4)], "c": np.diag([(2 * rule.position * h) ** 2] * 4 + [(10 * rule.velocity * h) ** 2] * 4)})
                out[0, frame, o] = n
    return out


def test_tracker_against_plain(spark):
    r = random.Random(4)
    rows = []
    for f in list(range(40)) + list(range(90, 130)):
        for o in range(5):
            if r.random() < 0.85:
                rows.append((0, f, o, at(150 * o + 4 * f * (1 if o % 2 else -1) + r.random(), 60 + 2 * f + r.random()), r.choice([0.05, 0.3, 0.9, 0.95])))
    rule = TrackRule(keep=8)
    got = ids(spark, rows, rule)
    assert got == plain_tracks(rows, rule) and len(set(got.values())) >= 10


def test_tracker_cases(spark):
    still = [(1, f, o, at(100 * o, 50), 0.9) for f in range(30) for o in range(3)]
    assert sorted(set(ids(spark, still).values())) == [1, 2, 3]
    gone = [(1, f, 0, at(10, 10), 0.9) for f in [*range(5), *range(8, 12), *range(60, 64)]]
    assert [ids(spark, gone, TrackRule(keep=3))[1, f, 0] for f in (4, 8, 60)] == [1, 1, 2]
    assert [ids(spark, gone, TrackRule(keep=2))[1, f, 0] for f in (4, 8, 60)] == [1, 2, 3]
    faint = [(1, 0, 0, at(0, 0), 0.3), (1, 1, 0, at(0, 0), 0.9), (1, 2, 0, at(0, 0), 0.2), (1, 3, 0, at(0, 0), 0.05), (1, 4, 0, at(0, 0), 0.2), (1, 5, 0, at(0, 0), 0.6)]
    assert ids(spark, faint) == {(1, 1, 0): 1, (1, 2, 0): 1, (1, 5, 0): 1}
    odd = [(1, 0, 0, at(0, 0), None), (1, 0, 1, None, 0.9), (2, 0, 0, at(0, 0), 0.9), (2, 0, 1, at(0, 0), 0.9)]
    assert sorted(ids(spark, odd).values()) == [1, 2]
    assert ids(spark, [(1, 0, 0, at(0, 0), 0.9)][:0]) == {}


def test_two_that_cross_keep_their_ids(spark):
    rows = [(0, f, o, at(10 * f if o == 0 else 400 - 10 * f, 12 * o), 0.9) for f in range(41) for o in range(2)]
    got = ids(spark, rows)
    assert len(set(got.values())) == 2 and all(got[0, f, 0] == got[0, 0, 0] for f in range(41))


def test_contested_matches_stay(spark):
    schema = "clip_id int, frame int, id int, x double, y double, w double, h double"
    truth = [(0, f, t, 10.0 * t, 0.0, 20.0, 40.0) for f in range(6) for t in (0, 1)]
    pred = [(0, f, 7 + t, 10.0 * t + (0 if f < 3 else 3 - 6 * t), 0.0, 20.0, 40.0) for f in range(6) for t in (0, 1)]
    r = evaluation.mot_metrics(spark.createDataFrame(truth, schema), spark.createDataFrame(pred, schema), 0.3).first()
    assert (r.num_switches, r.idf1, r.mota) == (0, 1.0, 1.0)


def test_camera_affines(spark):
    r = random.Random(7)
    rows, want = [], {}
    for f in range(6):
        a, b, tx, ty = 1 + 0.01 * f, 0.03 * f, 10.0 - f, -6.0
        want[f] = [a, -b, tx, b, a, ty]
        for i in range(60):
            x, y = r.uniform(0, 640), r.uniform(0, 360)
            out = 80 + r.uniform(0, 300) if i % 3 == 0 else 0
            rows.append((0, f, i, x, y, a * x - b * y + tx + r.gauss(0, 0.2) + out, b * x + a * y + ty + r.gauss(0, 0.2) - out))
    rows += [(0, 6, i, 1.0 * i, 2.0, 9.0 * i * i, 3.0) for i in range(5)]
    rows += [(0, 7, i, 5.0, 5.0, 5.0, 5.0) for i in range(9)]
    rows += [(0, 8, i, 10.0 * i, 7.0 * (i % 3), 10.0 * i, 7.0 * (i % 3)) for i in range(6)] + [(0, 8, 9, None, 1.0, 1.0, 1.0), (0, 8, 10, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, i int, x double, y double, u double, v double").repartition(3)
    plan = camera.camera_affines(df)
    got = {x.frame: (x.affine, x.inliers) for x in plan.collect()}
    for f, m in want.items():
        mine = [p for p in rows if p[1] == f and p[2] % 3]
        src = np.array([[p[3], -p[4], 1, 0] for p in mine] + [[p[4], p[3], 0, 1] for p in mine])
        a, b, tx, ty = np.linalg.lstsq(src, np.array([p[5] for p in mine] + [p[6] for p in mine]), rcond=None)[0]
        assert got[f][0] == pytest.approx([a, -b, tx, b, a, ty], abs=1e-8) and got[f][0] == pytest.approx(m, abs=0.5) and got[f][1] == 40
    for f in (6, 7):
        assert got[f][0] == list(camera.IDENTITY)
    assert got[8][0] == pytest.approx(list(camera.IDENTITY), abs=1e-12) and got[8][1] == 6
    assert camera.camera_affines(df.limit(0), ConsensusRule(draws=3)).count() == 0
    assert "Python" not in plan._jdf.queryExecution().toString()


def brute(p, model, targets, rule):
    """One weighted Gauss-Newton step by numerical slopes."""

    def residuals(q):
        out = []
        for fx, fy, tx, ty, nx, ny, weight in targets:
            w = q[6] * fx + q[7] * fy + 1
            out.append(weight * (((q[0] * fx + q[1] * fy + q[2]) / w - tx) * nx + ((q[3] * fx + q[4] * fy + q[5]) / w - ty) * ny))
        return np.array(out)

    r = residuals(p)
    eps = np.array([1e-5, 1e-5, 1e-4, 1e-5, 1e-5, 1e-4, 1e-8, 1e-8])
    j = np.stack([(residuals(p + e) - residuals(p - e)) / (2 * e.sum()) for e in np.diag(eps)], 1)
    h = np.where(np.abs(r) > rule.huber, rule.huber / np.abs(r), 1)
    scale = np.sqrt((h[:, None] * j * j).sum(0))
    return p - np.linalg.solve((j * h[:, None]).T @ j / np.outer(scale, scale), j.T @ (h * r) / scale) / scale


def test_refinement(spark):
    true = np.array([9.0, 0.4, 120, 0.3, 7.0, 80, 0.0008, 0.0012])
    first = true + np.array([0, 0, 3, 0, 0, -2.5, 0, 0])
    see = lambda q, x, y: ((q[0] * x + q[1] * y + q[2]) / (q[6] * x + q[7] * y + 1), (q[3] * x + q[4] * y + q[5]) / (q[6] * x + q[7] * y + 1))
    lines = [(0, 0, 40, 0), (40, 0, 40, 30), (0, 30, 40, 30), (0, 0, 0, 30)]
    spot = lambda c, t: (lines[c][0] + (lines[c][2] - lines[c][0]) * t, lines[c][1] + (lines[c][3] - lines[c][1]) * t)
    points = [(0, 5, c, i, *map(float, spot(c, i / 24))) for c in range(4) for i in range(25)]
    pixels = {tuple(round(v) for v in see(true, *spot(c, i / 800))) for c in range(4) for i in range(801)}
    dark = [(0, 5, x, y, 20) for x, y in pixels] + [(0, 5, x + 9, y + 8, 40) for x, y in sorted(pixels)[::40] if (x + 9, y + 8) not in pixels]
    corners = [(0, 5, float(x), float(y), *map(float, see(true, x, y))) for x, y in ((0, 0), (40, 0), (0, 30), (40, 30))]
    key = "clip_id int, frame int, "
    tables = (
        spark.createDataFrame(points, key + "curve int, i int, fx double, fy double"),
        spark.createDataFrame(dark, key + "px int, py int, gray int"),
        spark.createDataFrame(corners, key + "fx double, fy double, tx double, ty double"),
        spark.createDataFrame([(0, 5, first.tolist()), (0, 6, first.tolist())], key + "p array<double>"),
    )
    rule = RefineRule(rounds=4)
    targets = refinement.matched(*tables[:2], tables[3], rule).unionByName(refinement.anchors(tables[2], rule))
    rows = [(r.fx, r.fy, r.tx, r.ty, r.nx, r.ny, r.weight) for r in targets.collect()]
    assert len(rows) > 80
    step = refinement.solved(refinement.normal_equations(targets, tables[3], rule), rule).first().p
    want = brute(first, points, rows, rule)
    corner = [(x, y) for x in (0, 20, 40) for y in (0, 15, 30)]
    assert all(np.allclose(see(step, *c), see(want, *c), atol=1e-4) for c in corner)
    got = {r.frame: np.array(r.p) for r in refinement.refine(*tables, rule).collect()}
    assert max(math.dist(see(got[5], *c), see(true, *c)) for c in corner) < 0.5
    assert got[6].tolist() == first.tolist()  # nothing is known of frame 6


def plain_radius(h, w, m=0.7):
    """The three bounds as positive roots of their equations, the last two times their leading coefficients."""
    root = lambda *c: min(x.real for x in np.roots(c) if x.real > 0)
    same = root(1, -(h + w), h * w * (1 - m) / (1 + m))
    inner = 4 * root(4, -2 * (h + w), (1 - m) * h * w)
    outer = 4 * m * root(4 * m, 2 * m * (h + w), (m - 1) * h * w)
    return max(1.0, min(same, inner, outer))


def test_splat(spark):
    sizes = [(float(h), float(w)) for h in (1, 3, 10, 30, 55) for w in (2, 10, 30, 41)]
    df = spark.createDataFrame(sizes, "h double, w double").withColumn("r", splat.splat_radius(F.col("h"), F.col("w")))
    for r in df.collect():
        assert r.r == pytest.approx(plain_radius(r.h, r.w), rel=1e-6)
    assert all(r.r > 1 for r in df.where("h = 30 AND w = 30").collect())
    grid = 32
    boxes = [("a", 1, 0.5, 0.5, 0.9, 0.9), ("a", 2, 0.6, 0.5, 0.9, 0.9), ("a", 3, 1.0, 0.0, 0.1, 0.1), ("a", 4, 0.51, 0.51, 0.2, 0.3)]
    peaks = splat.targets(spark.createDataFrame(boxes, "image_id string, ord int, cx double, cy double, w double, h double"), grid)
    want = np.zeros((grid, grid))
    for p in peaks.collect():
        sigma = (2 * p.radius + 1) / 6
        for y in range(max(0, p.iy - p.radius), min(grid, p.iy + p.radius + 1)):
            for x in range(max(0, p.ix - p.radius), min(grid, p.ix + p.radius + 1)):
                want[y, x] = max(want[y, x], math.exp(-((x - p.ix) ** 2 + (y - p.iy) ** 2) / (2 * sigma * sigma)))
    got = np.zeros((grid, grid))
    for c in splat.heat_cells(peaks, grid).collect():
        got[c.iy, c.ix] = c.heat
    assert np.allclose(got, want) and got[16, 16] == 1.0 and got[0, 31] == 1.0
    last = splat.peak_cells(peaks, "ord").where("ix = 16 AND iy = 16").first()
    assert (round(last.w, 6), round(last.h, 6)) == (6.4, 9.6)


def test_loss_falls_towards_the_truth(spark):
    n = 16
    grid = [(0, x, y) for x in range(n) for y in range(n)]
    heat = spark.createDataFrame([(0, 8, 8, 1.0)], "image_id int, ix int, iy int, heat double")
    peaks = spark.createDataFrame([(0, 8, 8, 2.0, 3.0, 0.5, 0.25)], "image_id int, ix int, iy int, w double, h double, dx double, dy double")
    schema = "image_id int, ix int, iy int, logit double, pw double, ph double, pdx double, pdy double"
    right = spark.createDataFrame([(*c, 12.0 if c[1:] == (8, 8) else -12.0, 2.0, 3.0, 0.5, 0.25) for c in grid], schema)
    r = random.Random(1)
    wrong = spark.createDataFrame([(*c, r.gauss(0, 1), r.random(), r.random(), r.random(), r.random()) for c in grid], schema)
    good, bad = (splat.detection_loss(x, heat, peaks).first() for x in (right, wrong))
    assert good.total < 1e-3 < bad.total and good.wh == good.offset == 0
    assert bad.total == pytest.approx(bad.heatmap + 0.1 * bad.wh + bad.offset)


def test_random_homographies(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.lit(640.0).alias("w"), F.lit(360.0).alias("h"))
    h = draws.random_homography(F.col("k"), F.col("w"), F.col("h"))
    rows = df.select("k", h.alias("h"), F.array(*[draws.uniform(F.col("k"), i) for i in range(8)]).alias("u")).collect()
    assert sum(sum(r.u) for r in rows) / 1600 == pytest.approx(0.5, abs=0.03)
    for r in rows:
        m = np.array(r.h).reshape(3, 3)
        for i, (x, y) in enumerate(((0, 0), (640, 0), (640, 360), (0, 360))):
            q = m @ [x, y, 1]
            to = (x + (2 * r.u[2 * i] - 1) * 43.2, y + (2 * r.u[2 * i + 1] - 1) * 43.2)
            assert np.allclose(q[:2] / q[2], to, atol=1e-6)
            assert abs(to[0] - x) <= 43.2 and abs(to[1] - y) <= 43.2
    flat = [(F.lit(float(i)), F.lit(0.0)) for i in range(4)]
    assert df.select(draws.corner_homography(F.col("w"), F.col("h"), flat).alias("m")).where("m IS NOT NULL").count() == 0
