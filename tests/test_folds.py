"""Operators that run along a whole clip stay linear and equal their plain forms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import courts
from trackloom.operators import evaluation, heatmaps, registration, segments, shots

LONG = 200_000


def test_a_long_clip_ends(spark):
    """200,000 frames of one clip: what is quadratic in frames would not end here."""
    frames = spark.range(LONG).select(F.lit(0).alias("clip_id"), F.col("id").cast("int").alias("i"), F.when(F.col("id") % 7 != 3, F.col("id") % 50 * 1.0).alias("bx"))
    frames = frames.withColumn("by_", F.col("bx"))
    assert shots.fill_gaps(frames, 2).filter("bx is null").count() == 0
    v = frames.select("clip_id", F.col("i").alias("frame"), F.col("bx").alias("v"))
    assert registration.ema(v, 0.3).filter("e is not null").count() == LONG
    move = v.select("clip_id", "frame", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.5, 0.0, 1.0, -0.25)]).alias("affine"))
    last = registration.accumulated_motion(move).orderBy(F.desc("frame")).first()
    assert last.h[2] == LONG / 2 and last.h[5] == -LONG / 4
    shot = lambda name: spark.range(LONG // 10).select(F.lit(0).alias("clip_id"), F.col("id").alias(name), (F.col("id") * 3.0).alias("time_s"))
    assert shots.match_events(shot("event_ord"), shot("truth_ord")).filter("event_ord = truth_ord").count() == LONG // 10


@pytest.mark.parametrize("alpha", [0.02, 0.35, 1.0])
def test_ema_against_the_fold(spark, alpha):
    r = random.Random(1)
    vs = [None if r.random() < 0.2 else r.uniform(-9, 9) for _ in range(900)]
    want, e = [], None
    for v in vs:
        e = e if v is None else v if e is None else (1 - alpha) * e + alpha * v
        want.append(e)
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vs)], "clip_id int, frame int, v double")
    got = [x.e for x in registration.ema(df, alpha).orderBy("frame").collect()]
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], atol=1e-9)


def test_anchors_against_the_fold(spark):
    r = np.random.default_rng(6)
    rule = registration.RegistrarRule(alpha=0.3, max_misses=3)
    have = [r.random() < 0.5 for _ in range(60)] + [False] * 5 + [True] * 6 + [False] * 9
    full = courts.full_court()
    feet = np.array([full[i] for i in courts.SMOOTHED])
    hs = [np.array([[0.5, 0.01, 1], [0.0, 0.6, 2], [1e-4, 2e-4, 1]]) + r.normal(scale=1e-3, size=(3, 3)) * [[1], [1], [0]] if x else None for x in have]
    rows = [("c", f, None if h is None else [float(v) for v in h.ravel()]) for f, h in enumerate(hs)]
    got = registration.smoothed_anchors(spark.createDataFrame(rows, "clip_id string, frame long, h array<double>"), rule).orderBy("frame").collect()
    mean, idle = None, 0
    for h, x in zip(hs, got, strict=True):
        idle = idle + 1 if h is None else 0
        if idle > rule.max_misses:
            mean = None
        if h is not None:
            p = registration.apply_homography(np.linalg.inv(h), feet)
            mean = p if mean is None else 0.7 * mean + 0.3 * p
            assert x.last == 0 and np.allclose(np.array(x.anchors).reshape(-1, 2), mean)
        else:
            assert x.anchors is None


@pytest.mark.parametrize("parts", [1, 7, 400])
def test_average_precision_over_ranges_of_scores(spark, parts):
    r = random.Random(parts)
    rows = [(i % 40, i, r.choice((0.1, 0.5, 0.5, r.random())), (None if r.random() < 0.5 else i)) for i in range(600)]
    matched = spark.createDataFrame(rows, "image_id int, det_ord int, score double, hit int").repartition(37)
    truths = spark.range(900)
    tp, precision, recall = 0, [], [0.0]
    for k, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0], x[1]))):
        tp += x[3] is not None
        precision.append(tp / (k + 1))
        recall.append(tp / 900)
    for k in range(len(precision) - 2, -1, -1):
        precision[k] = max(precision[k], precision[k + 1])
    env = [precision[0], *precision]
    want = sum((recall[k + 1] - recall[k]) * (env[k] + env[k + 1]) / 2 for k in range(600))
    assert evaluation.average_precision(matched, truths, parts).first()[0] == pytest.approx(want)


def test_peaks_of_a_table_with_holes(spark):
    r = random.Random(2)
    cells = {(x, y): r.choice((0.2, 0.4, 0.6, 0.8)) for x in range(12) for y in range(9) if r.random() < 0.6}
    near = lambda x, y: [cells[p] for i in (-1, 0, 1) for j in (-1, 0, 1) if (p := (x + i, y + j)) in cells]
    want = sorted((-s, y, x) for (x, y), s in cells.items() if s >= 0.3 and s >= max(near(x, y)))[:10]
    df = spark.createDataFrame([(0, x, y, s, 1.0, -1.0, 0.5, 2.0) for (x, y), s in cells.items()], "image_id int, x int, y int, score double, w double, h double, dx double, dy double")
    got = heatmaps.peaks(df, 10).collect()
    assert sorted((-p.score, p.y, p.x) for p in got) == want
    assert all(p.box.y1 == p.box.y2 == (p.y + 1) * 4 and p.box.x2 - p.box.x1 == 4 and p.box.x1 == (p.x + 0.5) * 4 - 2 for p in got)


def test_first_frames(spark):
    f = spark.createDataFrame([(c, i) for c in range(2) for i in range(20)], "clip_id int, frame int")
    assert sorted((x.clip_id, x.frame) for x in segments.first_frames(f, 3, 2).collect()) == [(0, 0), (0, 3), (1, 0), (1, 3)]
    assert segments.first_frames(f, 5).count() == 8


def test_identity_is_assigned_group_by_group(spark):
    rows = [("c", f, 100 * k + (f > 6), 50.0 * k, 0.0, 10.0, 10.0) for k in range(40) for f in range(10)]
    schema = "clip_id string, frame int, id int, x double, y double, w double, h double"
    truth = spark.createDataFrame([(c, f, i // 100, *b) for c, f, i, *b in rows], schema)
    m = evaluation.mot_metrics(truth, spark.createDataFrame(rows, schema)).first()
    assert m.idf1 == pytest.approx(0.7) and m.num_switches == 40 and m.mota == pytest.approx(0.9)


def test_unknown_curves_are_an_error(spark):
    with pytest.raises(ValueError, match="unknown curves: moon"):
        courts.half_curves(spark, ["moon", "three"])
