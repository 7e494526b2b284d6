"""The tracker runs once, takes all pieces of a block a frame on at once, and gives the same ids however its rows come."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tests.test_perception import DET, at, plain_tracks
from trackloom.operators import tracking
from trackloom.operators.tracking import TrackRule

RULE = TrackRule(keep=8)


def crossing(seed, clip, frames):
    """Six boxes, some of which meet; (clip, frame, det_ord, box, conf)."""
    r = random.Random(seed)
    spots = [(f, o) for f in frames for o in range(6) if r.random() < 0.85]
    return [(clip, f, o, at(100 * o + 4 * f * (1 if o % 2 else -1) + r.random(), 60 + r.random()), r.choice([0.05, 0.3, 0.9, 0.95])) for f, o in spots]


def followed(rows, size, rule=RULE):
    """{(clip, frame, det_ord): id} of rows (clip, frame, det_ord, box, conf) of one piece a clip, that come in batches of size."""
    names = ["clip_id", "piece", "frame", "det_ord", "conf", "cx", "cy", "w", "h"]
    values = [(c, 0, f, o, conf, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]) for c, f, o, b, conf in sorted(rows)]
    table = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*values, strict=True)), strict=True)))
    batches = (table.slice(k, size) for k in range(0, table.num_rows, size))
    return {(r["clip_id"], r["frame"], r["det_ord"]): r["local"] for b in tracking.followed(batches, rule) for r in b.to_pylist()}


def test_the_tracker_is_once_in_the_plan(spark):
    plan = tracking.track(spark.createDataFrame(crossing(1, 0, range(5)), DET), RULE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InPandas") + plan.count("InArrow") == 1


def test_pieces_go_on_together(monkeypatch):
    steps = []
    advance = tracking.Tracks.advance
    monkeypatch.setattr(tracking.Tracks, "advance", lambda self, step, *rows: steps.append(step) or advance(self, step, *rows))
    rows = [(clip, f + 7 * clip, o, at(100 * o, 50), 0.9) for clip in range(50) for f in range(10) for o in range(2)]
    got = followed(rows, 10_000)
    assert len(steps) == 20  # 49 pieces at once, then the last one, which is held to the end
    assert len(got) == len(rows) and all(v == o + 1 for (_, _, o), v in got.items())


@pytest.mark.parametrize("size", [1, 3, 40, 173, 10_000])
def test_blocks_of_any_size(size):
    clips = {c: crossing(c, c, range(3 * c, 3 * c + n)) for c, n in enumerate((40, 1, 25, 7, 60, 2, 90))}
    rows = [r for c in clips.values() for r in c]
    got = followed(rows, size)
    assert got == {k: v for c in clips.values() for k, v in followed(c, len(c)).items()}
    assert len({(c, v) for (c, _, _), v in got.items()}) > 30


@pytest.mark.parametrize("size", [5, 64, 10_000])
def test_many_clips_against_plain(spark, size):
    r = random.Random(9)
    lanes = lambda frames: [(f, o, at(150 * o + 4 * f + r.random(), 60 + 2 * f + r.random()), r.choice([0.05, 0.3, 0.9, 0.95])) for f in frames for o in range(4) if r.random() < 0.85]
    clips = {c: lanes([*range(5 * c, 5 * c + 12), *range(5 * c + 30, 5 * c + 36 + c)]) for c in range(9)}
    df = spark.createDataFrame([(c, *x) for c, rows in clips.items() for x in rows], DET).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {(x.clip_id, x.frame, x.det_ord): x.track_id for x in tracking.track(df, RULE).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(c, f, o): v for c, rows in clips.items() for (_, f, o), v in plain_tracks([(0, *x) for x in rows], RULE).items()}
