"""The whole analyses on small made-up clips."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import BOX, box
from tests.test_registration_io import FEET_TO_IMAGE, kp_table, seen
from trackloom.functions import courts
from trackloom.operators import registration as reg
from trackloom.operators.segments import segments
from trackloom.plans import games


def test_fixed_camera(spark):
    ball = [(60 + 5 * i, 200 - 13 * i) for i in range(10)] + [(110, 95), (110, 103), (110, 112), (110, 130)]
    dets = [("c", i, i, "ball", 0.9, box(x - 2, y - 2, x + 2, y + 2), i) for i, (x, y) in enumerate(ball)] + [("c", i, i, "rim", 0.9, box(100, 100, 120, 110), 99) for i in range(6)]
    players = [("c", i, i, t, box(x + i, 80, x + 10 + i, 110), i, t % 2) for i in range(14) for t, x in ((1, 95), (2, 400))] + [("c", i, i, 3, box(96 + i, 80, 106 + i, 110), i, 1) for i in range(14, 40)]
    frames = spark.createDataFrame([("c", i, i) for i in range(40)], "clip_id string, i int, frame int")
    b = spark.createDataFrame(players, f"clip_id string, i int, frame int, track_id long, box {BOX}, ord int, team int")
    d = spark.createDataFrame(dets, f"clip_id string, i int, frame int, class_name string, conf double, box {BOX}, ord int")
    f = spark.createDataFrame([("c", t, [1.0, 0.0]) for t in (1, 3)] + [("c", 2, [0.0, 1.0])], "clip_id string, track_id long, feature array<double>")
    h = F.array(*[F.lit(v) for v in (0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0)])
    from trackloom.operators.shots import ShotConfig

    a = games.fixed_camera(b, d, frames, 30.0, h, f, cfg=ShotConfig(min_coverage=0.2))
    e = a["events"].collect()
    assert [(x.i, x.outcome, x.shooter_track_id) for x in e] == [(8, "made", 1)]
    assert e[0].court_xy.x == pytest.approx(10.8) and e[0].team == 1
    assert {x.track_id: x.frames for x in a["stats"].collect()} == {1: 40}
    assert a["occupancy"].agg(F.sum("n")).first()[0] == 54
    a.unpersist()


def court_boxes(track, frames, start, step, ord_, team=0, clip="c"):
    out = []
    for k, f in enumerate(frames):
        x, y = reg.apply_homography(FEET_TO_IMAGE, np.array([[start + step * k, 25.0]]))[0]
        out.append((clip, f, track, box(x - 10, y - 60, x + 10, y), ord_, team))
    return out


BOXES = f"clip_id string, frame int, track_id long, box {BOX}, ord int, team int"
READS = f"clip_id string, frame int, read_id int, box {BOX}, number string"


def reads_on(boxes, number, every=3):
    return [(b[0], b[1], i, (b[3][0] + 5, b[3][1] + 10, b[3][0] + 15, b[3][1] + 25), number) for i, b in enumerate(boxes) if i % every == 0]


def test_panning_camera(spark):
    one, two = court_boxes(1, range(20), 20.0, 0.2, 0), court_boxes(2, range(25, 45), 24.5, 0.2, 1)
    other = court_boxes(5, range(45), 70.0, 0.1, 2, 1)
    rows = reads_on(one, "23", 7) + [(r[0], r[1], 100 + r[2], *r[3:]) for r in reads_on(two, "23", 7)] + [("c", 3, 500, other[3][3], "unreadable")]
    idx = list(courts.planar())
    a = games.panning_camera(
        spark.createDataFrame(one + two + other, BOXES), kp_table(spark, [(f, idx, seen(idx)) for f in range(45)]),
        spark.createDataFrame([("c", f) for f in range(45)], "clip_id string, frame int"), spark.createDataFrame(rows, READS), 10.0,
        spark.createDataFrame([("c", t, v) for t, v in ((1, [1.0, 0.0]), (2, [1.0, 0.1]), (5, [0.0, 1.0]))], "clip_id string, track_id long, feature array<double>"),
    )
    players = {r.track_id: r for r in a["players"].collect()}
    assert set(players) == {1, 5} and players[1].number == "23" and players[5].number is None
    assert players[1].frames == 40 and players[5].distance_ft == pytest.approx(4.4, abs=0.3)
    t = a["telemetry"].first()
    assert (t.tracks_after_stitch, t.tracks_identified, t.read_rate, t.read_histogram) == (2, 1, 0.5, "23=6")
    assert a["rate"].first().court_analytics == "ok"
    a.unpersist()


def test_full_game(spark):
    live = [*range(0, 60), *range(200, 260)]
    samples = spark.createDataFrame([("g", f, f in live) for f in range(0, 300, 5)], "clip_id string, frame int, registered boolean")
    b = court_boxes(1, range(0, 60), 20.0, 0.2, 0, clip="g") + court_boxes(9, range(200, 260), 40.0, 0.2, 1, clip="g") + court_boxes(7, range(100, 150), 40.0, 0.2, 1, clip="g")
    r = reads_on(b[:60], "5") + reads_on(b[60:120], "5")
    idx = list(courts.planar())
    k = kp_table(spark, [(f, idx, seen(idx)) for f in live]).withColumn("clip_id", F.lit("g"))
    tables = {"boxes": spark.createDataFrame(b, BOXES), "keypoints": k, "frames": spark.createDataFrame([("g", f) for f in live], "clip_id string, frame int"), "reads": spark.createDataFrame(r, READS)}
    a = games.full_game(samples, tables, 10.0, min_len_s=3.0, max_gap_s=1.0)
    assert [(s.start_frame, s.end_frame) for s in a["segments"].orderBy("segment").collect()] == [(0, 55), (200, 255)]
    total = a["totals"].collect()
    assert [(t.number, t.segments) for t in total] == [("5", 2)] and total[0].seconds == pytest.approx(11.0)
    assert a["identified"].first().identified_time_fraction == 1.0 and a["duplicates"].count() == 0
    assert games.analysable_segments(samples, 10.0, 10.0, min_len_s=3.0, max_gap_s=1.0).count() == 1
    a.unpersist()
    assert segments(samples, F.lit(10.0), 3.0, 1.0).count() == 2
