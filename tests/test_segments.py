from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import segments


def samples(spark, pattern, stride=30):
    rows = [(0, i * stride, c == "R") for i, c in enumerate(pattern)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "clip_id int, frame int, registered boolean")


def spans(df, **kw):
    return sorted((r.start_frame, r.end_frame, r.duration_s) for r in segments.segments(df, F.lit(30.0), **kw).collect())


@pytest.mark.parametrize(
    ("pattern", "least", "want"),
    [
        ("RRRRRRRRRR", 8, [(0, 270, 9.0)]),
        ("RRR", 8, []),
        ("RRRRRFFFFRRRRR", 3, [(0, 120, 4.0), (270, 390, 4.0)]),
        ("RRRRRFRRRRR", 8, [(0, 300, 10.0)]),
        ("FFFRRRRRRRR", 3, [(90, 300, 7.0)]),
    ],
)
def test_patterns(spark, pattern, least, want):
    assert spans(samples(spark, pattern), min_len_s=least) == want


def test_pause_without_failed_sample_stays_open(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 9000, True)], "clip_id int, frame int, registered boolean")
    assert spans(df) == [(0, 9000, 300.0)]


def test_failed_sample_first_on_equal_frames(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 300, True), (0, 300, False)], "clip_id int, frame int, registered boolean")
    assert spans(df, min_len_s=0) == [(0, 0, 0.0), (300, 300, 0.0)]


def plain(rows, fps, least, gap):
    out, start, last = [], None, None
    for frame, ok in sorted(rows):
        if ok:
            start, last = (frame if start is None else start), frame
        elif start is not None and (frame - last) / fps > gap:
            out.append((start, last, (last - start) / fps))
            start = None
    if start is not None:
        out.append((start, last, (last - start) / fps))
    return [s for s in out if s[2] >= least]


def test_against_the_sequential_rule(spark):
    r = random.Random(5)
    rows = sorted({(r.randint(0, 4000), r.random() < 0.7) for _ in range(400)})
    df = spark.createDataFrame([(0, *x) for x in rows], "clip_id int, frame int, registered boolean")
    assert spans(df, min_len_s=1.0) == plain(rows, 30, 1.0, 2.0)


def test_summaries(spark):
    s = samples(spark, "RRRRRFFFFF")
    assert segments.coverage(s).first().coverage == 0.5
    segs = segments.segments(samples(spark, "RRRRRFFFFRRRRR"), F.lit(30.0), 3.0)
    row = segments.analysable(segs).first()
    assert (row.analysable_s, row.n_segments) == (8.0, 2)
    assert spans(s.limit(0)) == []


def test_runs_and_scans(spark):
    m = spark.createDataFrame([(0, i, c == "1") for i, c in enumerate("0110111010011")], "clip_id int, i int, on boolean")
    assert sorted((r.start, r.end) for r in segments.true_runs(m).collect()) == [(1, 2), (4, 6), (11, 12)]
    f = spark.createDataFrame([(0, i) for i in range(100)], "clip_id int, frame int")
    assert [r.frame for r in segments.sampled(f, 29.97, 1.0).orderBy("frame").collect()] == [0, 30, 60, 90]
    assert [r.i for r in segments.window_frames(f, 10.0, 1.0, 2.0, 5).orderBy("i").collect()] == [0, 5, 10, 15]
    assert [r.frame for r in segments.read_frames(f, 40).orderBy("frame").collect()] == [0, 40, 80]
