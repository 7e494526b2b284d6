from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import BOX, XY, box
from trackloom.functions import geometry as g
from trackloom.operators import boxscore, identity, stitch
from trackloom.operators.stitch import CourtRule, PixelRule


def reads(spark, rows):
    return spark.createDataFrame([(0, f, i, b, n) for i, (f, b, n) in enumerate(rows)], f"clip_id int, frame int, read_id int, box {BOX}, number string")


def boxes(spark, rows):
    return spark.createDataFrame([(0, f, t, b, i) for i, (f, t, b) in enumerate(rows)], f"clip_id int, frame int, track_id long, box {BOX}, ord int")


def test_ios(spark):
    rows = [(box(2, 2, 4, 4), box(0, 0, 10, 10)), (box(0, 0, 1, 1), box(5, 5, 6, 6)), (box(0, 0, 10, 10), box(5, 0, 25, 10)), (box(0, 0, 0, 5), box(0, 0, 9, 9))]
    df = spark.createDataFrame(rows, f"a {BOX}, b {BOX}")
    assert [r[0] for r in df.select(g.ios(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5, 0.0]


def test_matching(spark):
    r = reads(spark, [(0, box(2, 2, 4, 4), "23"), (0, box(50, 50, 60, 60), "8"), (1, box(2, 2, 4, 4), "9"), (2, box(1, 1, 3, 3), "00")])
    b = boxes(spark, [(0, 1, box(0, 0, 10, 10)), (0, 2, box(0, 0, 10, 10)), (2, 3, box(0, 0, 3, 3)), (0, 4, box(55, 55, 70, 70))])
    got = {(x.track_id, x.frame, x.number) for x in identity.match_reads(r, b).collect()}
    assert got == {(2, 0, "23"), (3, 2, "00")}  # of equal boxes the last one


def votes(spark, rows):
    return spark.createDataFrame([(0, 1, i, i, n) for i, n in enumerate(rows)], "clip_id int, track_id long, frame int, read_id int, number string")


@pytest.mark.parametrize(("given", "want"), [(["23"] * 2, None), (["23"] * 3 + ["8"], "23"), (["23", "23", "8", "8"], None), (["8"] * 3 + ["23"] * 3, "8"), (["1"] * 3 + ["2"] * 2 + ["3"] * 2, None)])
def test_votes(spark, given, want):
    got = identity.confirm_numbers(votes(spark, given)).collect()
    assert [r.number for r in got] == ([want] if want else [])


def merge(spark, spans, numbers):
    s = spark.createDataFrame([(0, t, a, b, i) for i, (t, a, b) in enumerate(spans)], "clip_id int, track_id long, start int, end int, ord int")
    c = spark.createDataFrame([(0, t, n) for t, n in numbers.items()], "clip_id int, track_id long, number string")
    return {r.track_id: r.canonical_id for r in identity.merge_by_number(c, s).collect()}


def test_merging(spark):
    assert merge(spark, [(1, 0, 10), (2, 11, 20)], {1: "5", 2: "5"}) == {1: 1, 2: 1}
    assert merge(spark, [(1, 0, 10), (2, 10, 20)], {1: "5", 2: "5"}) == {1: 1, 2: 2}
    assert merge(spark, [(1, 0, 10), (2, 11, 20)], {1: "5", 2: "6"}) == {1: 1, 2: 2}
    assert merge(spark, [(3, 0, 5), (2, 6, 8), (1, 9, 12), (7, 0, 1)], {1: "5", 2: "5", 3: "5"}) == {1: 1, 2: 1, 3: 1, 7: 7}


@pytest.mark.parametrize("seed", range(3))
def test_first_fit(spark, seed):
    r = random.Random(seed)
    spans = [(i, a, a + r.randint(0, 9)) for i, a in enumerate(r.randint(0, 60) for _ in range(40))]
    groups = []
    for t, a, b in sorted(spans, key=lambda s: s[1]):
        for q in groups:
            if a > q[0]:
                q[0] = max(q[0], b)
                q[1].append(t)
                break
        else:
            groups.append([b, [t]])
    assert merge(spark, spans, {t: "1" for t, _, _ in spans}) == {t: min(q[1]) for q in groups for t in q[1]}


def test_identify_end_to_end(spark):
    b = boxes(spark, [(f, 1 if f < 5 else 2, box(0, 0, 10, 10)) for f in range(10)])
    r = reads(spark, [(f, box(2, 2, 4, 4), "23") for f in (0, 1, 2, 6, 7, 8)])
    spans = identity.spans_of(b)
    remap, numbers = identity.identify(r, b, spans)
    assert {x.track_id: x.canonical_id for x in remap.collect()} == {1: 1, 2: 1}
    assert [(x.track_id, x.number) for x in numbers.collect()] == [(1, "23")]
    assert {x.track_id for x in identity.remapped(b, remap).collect()} == {1}
    assert identity.remapped_spans(spans, remap).first().end == 9
    t = identity.telemetry(r, identity.match_reads(r, b), numbers, spans, identity.remapped(b, remap)).first()
    assert (t.tracks_after_stitch, t.tracks_after_merge, t.tracks_identified, t.max_votes, t.read_histogram, t.read_rate) == (2, 1, 1, 3, "23=6", 0.5)


def test_mined_players(spark):
    p, n = boxes(spark, [(0, 1, box(0, 0, 10, 10)), (0, 2, box(20, 0, 30, 10))]), reads(spark, [(0, box(4, 4, 6, 6), "1")])
    assert [r.track_id for r in identity.mined_abstentions(p, n, 10, 1).collect()] == [2]


def tracklets(spark, rows, feature=(1.0, 0.0)):
    data = [(0, t, a, b, tuple(map(float, p)), tuple(map(float, q)), 40.0, 40.0, list(f or feature), i) for i, (t, a, b, p, q, f) in enumerate(rows)]
    return spark.createDataFrame(data, f"clip_id int, track_id long, start_frame int, end_frame int, start_xy {XY}, end_xy {XY}, start_h double, end_h double, feature array<double>, ord int")


def linked(spark, rows, rule):
    return {r.track_id: r.canonical_id for r in stitch.link(tracklets(spark, rows), rule).collect()}


def test_pixel_linking(spark):
    px = PixelRule()
    assert linked(spark, [(1, 0, 10, (100, 100), (100, 100), None), (2, 13, 25, (108, 102), (200, 150), None)], px) == {1: 1, 2: 1}
    assert linked(spark, [(1, 0, 20, (100, 100), (100, 100), None), (2, 5, 25, (100, 100), (100, 100), None)], px) == {1: 1, 2: 2}
    assert linked(spark, [(1, 0, 10, (0, 0), (0, 0), None), (2, 13, 25, (500, 0), (500, 0), None)], px) == {1: 1, 2: 2}
    assert linked(spark, [(1, 0, 10, (0, 0), (0, 0), (1.0, 0.0)), (2, 13, 25, (0, 0), (0, 0), (0.0, 1.0))], px) == {1: 1, 2: 2}
    assert linked(spark, [(1, 0, 10, (0, 0), (0, 0), None), (2, 101, 125, (0, 0), (0, 0), None)], px) == {1: 1, 2: 2}
    chain = [(i, 20 * i, 20 * i + 10, (0, 0), (0, 0), None) for i in (1, 2, 3)]
    assert linked(spark, chain, px) == {1: 1, 2: 1, 3: 1}
    two = [(1, 0, 10, (0, 0), (0, 0), None), (2, 0, 10, (300, 0), (300, 0), None), (3, 12, 20, (5, 0), (5, 0), None), (4, 12, 20, (305, 0), (305, 0), None)]
    assert linked(spark, two, px) == {1: 1, 2: 2, 3: 1, 4: 2}
    assert linked(spark, [(1, 0, 10, (0, 0), (0, 0), (0.0,)), (2, 13, 25, (0, 0), (0, 0), (0.0,))], px) == {1: 1, 2: 2}


def test_court_linking(spark):
    ft = CourtRule()
    assert linked(spark, [(1, 0, 10, (40, 25), (40, 25), None), (2, 20, 40, (43, 25), (60, 25), None)], ft) == {1: 1, 2: 1}
    assert linked(spark, [(1, 0, 10, (40, 25), (40, 25), None), (2, 12, 40, (60, 25), (60, 25), None)], ft) == {1: 1, 2: 2}
    assert linked(spark, [(1, 0, 10, (40, 25), (40, 25), None), (2, 40, 60, (60, 25), (60, 25), None)], ft) == {1: 1, 2: 1}
    assert stitch.link(tracklets(spark, [(1, 0, 1, (0, 0), (0, 0), None)]).limit(0), ft).count() == 0


def union_find(rows, fps=30.0):
    """The rule read literally: every tracklet against every earlier one, through group roots."""
    import math

    rows = sorted(rows, key=lambda r: r[1])
    up = list(range(len(rows)))
    end = [(r[2], r[4]) for r in rows]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for j, r in enumerate(rows):
        best, top = None, -math.inf
        for i in range(j):
            q = find(i)
            gap = (r[1] - end[q][0]) / fps
            if gap <= 0 or gap > 1.5:
                continue
            reach = 3.0 + 25.0 * gap
            d = math.dist(end[q][1], r[3])
            like = sum(a * b for a, b in zip(rows[q][5], r[5], strict=True))
            if d > reach or like < 0.5:
                continue
            if (s := like - 0.5 * d / reach - 0.5 * gap / 1.5) > top:
                best, top = q, s
        if best is not None:
            up[j] = best
            end[best] = (r[2], r[4])
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    return {t: min(v) for v in ids.values() for t in v}


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    import math

    r = random.Random(seed)
    rows = []
    for t in range(60):
        a, w = r.randint(0, 300), r.uniform(0, 1.5)
        rows.append((t, a, a + r.randint(1, 40), (r.uniform(0, 30), r.uniform(0, 30)), (r.uniform(0, 30), r.uniform(0, 30)), (math.cos(w), math.sin(w))))
    assert linked(spark, rows, CourtRule()) == union_find(rows)


def test_tracklet_build(spark):
    b = spark.createDataFrame([(0, 1, i, box(i, 0, i + 2, 10 + i), i) for i in (3, 1, 2)], f"clip_id int, track_id long, i int, box {BOX}, ord int")
    f = spark.createDataFrame([(0, 1, [3.0, 0.0]), (0, 1, [0.0, 4.0])], "clip_id int, track_id long, feature array<float>")
    r = stitch.tracklets(b, f).first()
    assert (r.start_frame, r.end_frame, r.start_xy.x, r.end_xy.x, r.start_h, r.end_h) == (1, 3, 2.0, 4.0, 11.0, 13.0)
    assert r.feature == pytest.approx([0.6, 0.8])
    assert stitch.tracklets(b).first().feature == [0.0]


def rows(spark, data):
    return spark.createDataFrame(data, "segment int, track_id int, number string, seconds double, distance_ft double, top_speed_mph double")


def test_box_score(spark):
    df = rows(spark, [(0, 1, "23", 10.0, 50.0, 12.0), (1, 4, "23", 20.0, 100.0, 15.0), (0, 2, None, 10.0, 40.0, 9.0), (1, 3, None, 20.0, 60.0, 9.0), (1, 5, "23", 0.0, 0.0, 1.0)])
    t = boxscore.number_totals(df).first()
    assert (t.segments, t.seconds, t.distance_ft, t.top_speed_mph) == (2, 30.0, 150.0, 15.0)
    assert t.avg_speed_mph == pytest.approx(5 * 0.681818)
    m = boxscore.identified_time(df).first()
    assert (m.identified_numbers, m.identified_rows, m.anonymous_rows, m.anonymous_seconds, m.anonymous_distance_ft, m.identified_time_fraction) == (1, 3, 2, 30.0, 100.0, 0.5)
    m = boxscore.identified_time(df.limit(0)).first()
    assert (m.identified_numbers, m.identified_time_fraction) == (0, 0.0)
    assert boxscore.best(df, "distance_ft").first().track_id == 4
