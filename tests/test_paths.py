from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import BOX, box, path
from trackloom.operators import paths

MPH = 0.681818


def stats(df, **kw):
    return {r.track_id: r for r in paths.movement_stats(df, **kw).collect()}


def test_straight_line(spark):
    df = path(spark, [(1, i, i / 10, 10.0 + i, 10.0, 0) for i in range(20)])
    r = stats(df, min_frames=5, window=1)[1]
    assert (r.frames, r.team) == (20, 0)
    assert r.distance_ft == pytest.approx(19.0)
    assert r.avg_speed_mph == pytest.approx(10 * MPH) and r.top_speed_mph == pytest.approx(10 * MPH)


def test_short_tracks_drop_out(spark):
    assert stats(path(spark, [(1, i, i / 10, float(i), 0.0, 0) for i in range(6)])) == {}


@pytest.mark.parametrize("far", [49.0, 90.0])
def test_teleports_do_not_count(spark, far):
    df = path(spark, [(1, i, i / 10, far if i == 10 else 10.0, 10.0, None) for i in range(20)])
    r = stats(df, window=1)[1]
    assert r.distance_ft < 5 and r.team is None


def test_nothing_possible(spark):
    assert stats(path(spark, [(1, i, i / 10, 50.0 * (i % 2), 10.0, 0) for i in range(20)]), window=1) == {}


def test_order_and_empty(spark):
    rows = [(1, i, i / 10, 2.0 * i, 0.0, 0) for i in range(20)] + [(2, i, i / 10, 5.0, 0.01 * i, 1) for i in range(20)]
    out = paths.present(paths.movement_stats(path(spark, rows), window=1)).collect()
    assert [r.track_id for r in out] == [1, 2]
    assert paths.movement_stats(path(spark, rows).limit(0)).count() == 0


def test_team_ties_go_to_the_first_seen_and_null_counts(spark):
    teams = [1, 0, 0, 1] * 5
    assert stats(path(spark, [(1, i, i / 10, 0.1 * i, 0.0, t) for i, t in enumerate(teams)]))[1].team == 1
    teams = [0, None, None, 1] * 5
    assert stats(path(spark, [(1, i, i / 10, 0.1 * i, 0.0, t) for i, t in enumerate(teams)]))[1].team is None


def plain(points, t, window, cap):
    p = np.array(points, float)
    if len(p) >= 3 and window >= 2:
        h = window // 2
        p = np.array([p[max(0, i - h) : i + h + 1].mean(0) for i in range(len(p))])
    seg, dt = np.sqrt((np.diff(p, axis=0) ** 2).sum(1)), np.diff(t)
    speed = seg / dt
    ok = speed <= cap
    return seg[ok].sum(), np.percentile(speed[ok], 95)


@pytest.mark.parametrize("window", [1, 2, 5])
def test_against_numpy(spark, window):
    r = np.random.default_rng(window)
    pts = np.cumsum(r.normal(size=(60, 2)), 0)
    df = path(spark, [(1, i, i / 10, float(x), float(y), 0) for i, (x, y) in enumerate(pts)])
    got = stats(df, window=window, cap=12.0)[1]
    want, top = plain(pts, np.arange(60) / 10, window, 12.0)
    assert got.distance_ft == pytest.approx(want) and got.top_speed_mph == pytest.approx(top * MPH)


def test_static_camera(spark):
    rows = [(0, i, 1, i, box(9 + i, 5, 11 + i, 10), 0) for i in range(20)] + [(0, 0, 2, 0, box(500, 0, 510, 10), 0)]
    b = spark.createDataFrame(rows, f"clip_id int, frame int, track_id int, ord int, box {BOX}, team int")
    eye = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    out = paths.player_stats(b, eye, F.lit(10.0), window=1).collect()
    assert [r.track_id for r in out] == [1] and out[0].distance_ft == pytest.approx(19.0)


def test_occupancy_edges(spark):
    df = path(spark, [(1, 0, 0.0, 50.0, 47.0, 0), (1, 1, 1.0, 0.0, 0.0, 0), (1, 2, 2.0, 50.1, 3.0, 0), (1, 3, 3.0, 49.5, 46.9, 0)])
    assert {(r.bx, r.by_): r.n for r in paths.occupancy(df).collect()} == {(49, 46): 2, (0, 0): 1}


def test_smoothing_keeps_mass(spark):
    df = path(spark, [(1, 0, 0.0, 0.0, 0.0, 0), (1, 1, 1.0, 25.5, 20.5, 0), (1, 2, 2.0, 49.9, 46.9, 0)])
    out = paths.smoothed_occupancy(paths.occupancy(df)).collect()
    assert sum(r.n for r in out) == pytest.approx(3.0)
    w = paths.kernel(1.2)
    top = {(r.bx, r.by_): r.n for r in out}[25, 20]
    assert top == pytest.approx(w[len(w) // 2] ** 2, rel=1e-6)
