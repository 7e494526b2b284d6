from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import BOX, box
from trackloom.functions import courts
from trackloom.functions import geometry as g
from trackloom.operators import registration as reg
from trackloom.sources import readers, writers

FEET_TO_IMAGE = np.array([[9.0, 2.0, 80.0], [-1.0, -7.0, 600.0], [0.0004, -0.004, 1.0]])


def seen(idx, noise=0.0, seed=0):
    full = courts.full_court()
    p = reg.apply_homography(FEET_TO_IMAGE, np.array([full[i] for i in idx]))
    return p + np.random.default_rng(seed).normal(scale=noise, size=p.shape) if noise else p


def kp_table(spark, frames):
    rows = [("c", f, int(i), float(x), float(y), 0.9) for f, idx, pts in frames for i, (x, y) in zip(idx, pts, strict=True)]
    return spark.createDataFrame(rows, "clip_id string, frame int, kp int, x double, y double, conf double")


def test_full_court_is_symmetric():
    full = courts.full_court()
    assert len(full) == 33 and len(courts.planar()) == 31
    for i, j in courts.FULL_MIRROR.items():
        assert full[i] == (94.0 - full[j][0], full[j][1])
    assert full[26] == (88.75, 25.0) and full[16] == (47.0, 25.0) and full[27] == (94.0, 50.0)


def test_half_court_profiles():
    nba, hs = courts.half_court("nba"), courts.half_court("hs")
    assert nba["three-pt-arc-top"] == (25.0, 29.0) and nba["corner-three-right"] == (47.0, 14.0)
    assert hs["corner-three-left"] is None and hs["paint-left-baseline"] == (19.0, 0.0)
    assert courts.paint_corners("nba") == [(17.0, 0.0), (33.0, 0.0), (17.0, 19.0), (33.0, 19.0)]
    m = courts.mirror_index()
    assert all(m[m[i]] == i for i in m) and m[0] == 1 and m[11] == 11


def test_vendor_court_agrees(spark):
    gaps = [r.gap_ft for r in reg.template_gaps(spark).collect()]
    assert np.mean(gaps) == pytest.approx(0.09, abs=0.02) and sum(x <= 0.1 for x in gaps) == 29


def test_homography_recovers(spark):
    idx = [0, 5, 9, 11, 13, 15, 17, 6]
    pts = seen(idx)
    pts[-1] += 500  # the basket is off the floor and must not matter
    r = reg.fit_frames(kp_table(spark, [(1, idx, pts), (2, idx[:3], pts[:3])])).collect()
    assert [x.frame for x in r] == [1] and 6 not in r[0].inliers
    back = reg.apply_homography(np.array(r[0].h).reshape(3, 3), seen([27, 32, 16]))
    assert np.abs(back - np.array([courts.full_court()[i] for i in (27, 32, 16)])).max() < 0.05


def test_outliers_are_left_out():
    idx = [0, 5, 9, 11, 13, 15, 17, 27, 32]
    src, dst = seen(idx), np.array([courts.full_court()[i] for i in idx])
    src[4] += 300
    _, mask = reg.robust_homography(src, dst, 1.0)
    assert not mask[4] and mask.sum() == 8
    assert reg.solve_homography(src[:3], dst[:3]) is None
    line = np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])
    assert reg.solve_homography(line, line) is None


def test_registrar(spark):
    idx = list(courts.planar())
    frames = [(f, idx, seen(idx, 2.0, f)) for f in range(12)] + [(f, idx[:2], seen(idx[:2])) for f in range(12, 34)] + [(34, idx, seen(idx))]
    every = spark.createDataFrame([("c", f) for f in range(36)], "clip_id string, frame int")
    out = {r.frame: r.h for r in reg.registered(kp_table(spark, frames), every).collect()}
    assert all(out[f] is not None for f in range(27)) and all(out[f] is None for f in range(27, 34))
    assert out[34] is not None and out[35] == out[34] and out[20] == out[11]
    centre = lambda h: reg.apply_homography(np.linalg.inv(np.array(h).reshape(3, 3)), np.array([[30.0, 20.0]]))[0]
    raw = {r.frame: r.h for r in reg.fit_frames(kp_table(spark, frames)).collect()}
    jump = lambda hs: np.mean([np.linalg.norm(centre(hs[f]) - centre(hs[f - 1])) for f in range(2, 12)])
    assert jump(out) < jump(raw)
    found = reg.registered(kp_table(spark, frames), every)
    assert reg.registration_rate(found).first().court_analytics == "ok"
    assert reg.registration_rate(found, 0.9).first().court_analytics == "unavailable"


def matrix(m):
    return F.array(*[F.lit(float(v)) for v in np.asarray(m).ravel()])


def test_projection_expressions(spark):
    h = np.linalg.inv(FEET_TO_IMAGE)
    df = spark.createDataFrame([(300.0, 200.0)], "x double, y double")
    p = g.project(matrix(h), F.col("x"), F.col("y"))
    r = df.select(p.alias("p")).select("p", g.project(g.inverse(matrix(h)), F.col("p.x"), F.col("p.y")).alias("q")).first()
    want = reg.apply_homography(h, np.array([[300.0, 200.0]]))[0]
    assert (r.p.x, r.p.y) == pytest.approx(tuple(want)) and (r.q.x, r.q.y) == pytest.approx((300.0, 200.0), abs=1e-6)
    flat = df.select(g.project(matrix([[1, 0, 0], [0, 1, 0], [0, 0, 0]]), F.col("x"), F.col("y")).alias("p"), g.inverse(matrix(np.zeros((3, 3)))).alias("i")).first()
    assert flat.p.x is None and flat.i is None


def test_keypoint_projection_flip_warp(spark):
    f = spark.createDataFrame([(1, 1280, 720)], "frame int, width int, height int")
    half = courts.half_table(spark, "hs")
    seen_ = reg.projected_keypoints(f, half, matrix(np.linalg.inv([[20, 0, 100], [0, 10, 50], [0, 0, 1]])))
    rows = {r.kp: (r.x, r.y, r.v) for r in seen_.collect()}
    assert rows[0] == pytest.approx((100.0, 50.0, 2)) and rows[9] == (0.0, 0.0, 0) and rows[11] == pytest.approx((600.0, 102.5, 2))
    twice = reg.flipped_keypoints(reg.flipped_keypoints(seen_)).collect()
    back = {r.kp: (r.x, r.y, r.v) for r in twice if r.kp is not None and r.v}
    assert set(back) == {k for k, v in rows.items() if v[2]} and all(v == pytest.approx(rows[k]) for k, v in back.items())
    moved = reg.warped_keypoints(seen_, matrix([[1, 0, 900], [0, 1, 0], [0, 0, 1]]))
    got = {r.kp: (r.x, r.v) for r in moved.collect()}
    assert got[0] == pytest.approx((1000.0, 2)) and got[1] == (0.0, 0) and got[9] == (0.0, 0)
    b = reg.keypoint_boxes(seen_, ["frame"]).first()
    assert (b.x, b.y, b.w) == pytest.approx((100.0, 50.0, 1000.0)) and b.n_visible == 14
    assert reg.keypoint_boxes(seen_.withColumn("v", F.lit(0)), ["frame"]).first().w == 0.0


def test_errors(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0), (1, 1.0, 1.0, 1.0, 1.0)], "kp int, x double, y double, fx double, fy double")
    r = reg.error_summary(reg.reprojection(df, matrix(np.eye(3)))).first()
    assert (r.mean_err, r.median_err, r.n) == (2.5, 2.5, 2)


def test_motion_and_average(spark):
    m = spark.createDataFrame([(0, 0, None), (0, 1, [1.0, 0.0, 2.0, 0.0, 1.0, 0.0]), (0, 2, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0])], "clip_id int, frame int, affine array<double>")
    out = {r.frame: r.h for r in reg.accumulated_motion(m).collect()}
    assert out[0] == list(np.eye(3).ravel())
    assert out[2] == list((np.array([[1, 0, 2], [0, 1, 0], [0, 0, 1.0]]) @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])).ravel())
    v = spark.createDataFrame([(0, 0, 10.0), (0, 1, None), (0, 2, 20.0)], "clip_id int, frame int, v double")
    assert [r.e for r in reg.ema(v, 0.35).orderBy("frame").collect()] == pytest.approx([10.0, 10.0, 13.5])


def test_corner_order(spark):
    corners = [(200.0, 400.0), (420.0, 420.0), (240.0, 250.0), (380.0, 255.0)]
    q = spark.createDataFrame([(1, [corners[i] for i in (2, 0, 3, 1)], (310.0, 430.0))], "id int, points array<struct<x:double,y:double>>, basket struct<x:double,y:double>")
    r = reg.ordered_corners(q).first()
    assert [tuple(c) for c in (r.baseline_left, r.baseline_right, r.ft_left, r.ft_right)] == corners
    r = reg.ordered_corners(q, flip=True).first()
    assert tuple(r.baseline_left) == corners[1] and tuple(r.ft_left) == corners[3]


def test_template_recovery(spark):
    full = courts.planar()
    rng, rows = np.random.default_rng(2), []
    idx = list(full)
    for im in range(12):
        h = FEET_TO_IMAGE + rng.normal(scale=[[0.3, 0.3, 20], [0.3, 0.3, 20], [1e-5, 1e-5, 0]])
        pick = rng.choice(idx, 12, replace=False)
        for i, (x, y) in zip(pick, reg.apply_homography(h, np.array([full[i] for i in pick])), strict=True):
            rows.append((im, int(i), float(x), float(y)))
    obs = spark.createDataFrame(rows, "image_id int, kp int, x double, y double")
    got = reg.recovered_template(obs, {i: full[i] for i in idx[:14]})
    assert set(got) == {r[1] for r in rows} | set(idx[:14])
    assert max(np.linalg.norm(np.subtract(got[i], full[i])) for i in got) < 0.1


def test_keypoint_gates(spark):
    df = kp_table(spark, [(1, [0, 5, 9, 6], seen([0, 5, 9, 6])), (2, [0, 5, 9, 11], seen([0, 5, 9, 11]))])
    assert {r.frame for r in reg.usable_keypoints(df, 0.5, 4, ["clip_id", "frame"]).collect()} == {2}
    two = df.withColumn("instance", F.lit(0)).union(df.filter("frame = 1").withColumn("instance", F.lit(1)).withColumn("conf", F.lit(0.95)))
    best = reg.best_instance(two, ["clip_id", "frame"]).select("frame", "instance").distinct().collect()
    assert {(r.frame, r.instance) for r in best} == {(1, 1), (2, 0)}


def test_mot_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("a", 0, 7, box(1, 2, 4, 6), 0.5, 0), ("a", 2, 7, box(1, 2, 4, 6), None, 1)], f"clip_id string, i int, track_id int, box {BOX}, conf double, ord int")
    writers.write_mot(b, str(tmp_path / "mot"))
    assert [r.value for r in writers.mot_lines(b).collect()] == ["1,7,1.0,2.0,3.0,4.0,0.500,-1,-1,-1", "3,7,1.0,2.0,3.0,4.0,1.000,-1,-1,-1"]
    got = readers.mot(spark, str(tmp_path / "mot" / "clip_id=a")).orderBy("frame").collect()
    assert [(r.frame, r.id, r.w, r.conf) for r in got] == [(1, 7, 3.0, 0.5), (3, 7, 3.0, 1.0)]
    (tmp_path / "x.txt").write_text("1,2,0,0,5,5,-1,-1,-1,-1\n\n4,2,0,0,5,5,,-1,-1,-1\n")
    m = readers.mot(spark, str(tmp_path / "x.txt"))
    assert [r.conf for r in m.collect()] == [1.0, 1.0] and m.first().clip_id == "x"
    assert readers.mot_frames(m).count() == 4


def test_text_readers(spark, tmp_path):
    (tmp_path / "seg.csv").write_text("time_s,outcome\n10.2, missed\n23.4,made \n")
    assert [(r.clip_id, r.time_s, r.outcome) for r in readers.shot_labels(spark, str(tmp_path / "seg.csv")).collect()] == [("seg", 10.2, "missed"), ("seg", 23.4, "made")]
    with pytest.raises(Exception):
        readers.shot_labels(spark, str(tmp_path / "none.csv")).count()
    (tmp_path / "im.txt").write_text("0 0.5 0.5 0.1 0.2\n1 0.1 0.1 0.1 0.1\n0 0.5\n")
    assert [r.h for r in readers.yolo_boxes(spark, str(tmp_path / "im.txt")).collect()] == [0.2]
    (tmp_path / "o.jsonl").write_text('{"image":"a","prefix":"p","suffix":"23"}\n{"image":"b","prefix":"p","suffix":""}\n')
    assert [r.label for r in readers.ocr(spark, str(tmp_path / "o.jsonl")).collect()] == ["23", "unreadable"]
    c = spark.createDataFrame([("a", 0.0, 60)], "clip_id string, fps double, frame_count int")
    assert tuple(readers.clip_info(c).first())[1:] == (30.0, 60, 2.0)


def test_calibration_round_trip(spark, tmp_path):
    pts = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    writers.write_calibration(spark, [1.0, 0, 0, 0, 1, 0, 0, 0, 1], pts, pts, str(tmp_path / "cal"))
    r = readers.calibration(spark, str(tmp_path / "cal")).first()
    assert r.homography == [1.0, 0, 0, 0, 1, 0, 0, 0, 1] and r.image_points == [list(p) for p in pts]


def test_coco_and_yolo(spark, tmp_path):
    coco = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 100, "height": 50}],
        "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "keypoints": [10, 20, 2, 0, 0, 0, 50, 40, 1]}, {"id": 8, "image_id": 1, "category_id": 4, "keypoints": []}],
        "categories": [{"id": 4, "name": "x"}, {"id": 3, "name": "court", "keypoints": ["p", "q", "r"]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(coco))
    k = readers.coco_keypoints(spark, str(tmp_path / "c.json"))
    assert [(r.kp, r.x, r.y, r.v) for r in k.orderBy("kp").collect()] == [(0, 10.0, 20.0, 2), (1, 0.0, 0.0, 0), (2, 50.0, 40.0, 1)]
    images = spark.createDataFrame([(1, "a.jpg", 100.0, 50.0), (2, "b.jpg", 100.0, 50.0)], "image_id long, file_name string, width double, height double")
    lines = {r.file_name: r.value for r in writers.yolo_pose_lines(images, k.select("image_id", "kp", "x", "y", "v")).collect()}
    assert lines["b.jpg"] == "" and lines["a.jpg"].startswith("0 0.300000 0.600000 0.400000 0.400000 0.100000 0.400000 2 0.000000 0.000000 0")
    rec = json.loads(writers.coco_records(k).first().value)
    assert rec["bbox"] == [10.0, 20.0, 40.0, 20.0] and rec["num_keypoints"] == 2 and len(rec["keypoints"]) == 9


def test_json_sinks_and_segment_cache(spark, tmp_path):
    from trackloom.operators import boxscore

    rows = spark.createDataFrame([(0, 1, "5", 10.0, 50.0, 12.0), (0, 2, "7", 30.0, 50.0, 12.0)], "segment int, track_id int, number string, seconds double, distance_ft double, top_speed_mph double")
    totals, meta = boxscore.number_totals(rows), boxscore.identified_time(rows)
    out = json.loads(writers.box_score(totals, meta).first().value)
    assert out["schema_version"] == 1 and [p["number"] for p in out["players"]] == ["7", "5"] and out["meta"]["identified_rows"] == 2
    assert "| 7 | 1 | 30.0 |" in writers.markdown_report(totals)
    seen_ = []

    def compute(todo):
        seen_.append(sorted(r.segment for r in todo.collect()))
        return todo.withColumn("v", F.col("segment") * 10)

    todo = spark.createDataFrame([(1,), (2,)], "segment int")
    assert writers.fill_segments(todo, str(tmp_path / "cache"), compute).count() == 2
    more = spark.createDataFrame([(1,), (2,), (3,)], "segment int")
    assert writers.fill_segments(more, str(tmp_path / "cache"), compute).count() == 3 and seen_ == [[1, 2], [3]]


def test_events_payload(spark):
    from trackloom.operators import shots

    found = spark.createDataFrame([(0, 0.1234, False, "no rim detected")], "clip_id int, coverage double, available boolean, reason string")
    ev = spark.createDataFrame([(1, 5, 0.5, "made")], "clip_id int, frame int, time_s double, outcome string")
    out = json.loads(writers.events_payload(found, ev).first().value)
    assert out == {"ball_coverage": 0.123, "available": False, "reason": "no rim detected", "events": []}
    assert shots
