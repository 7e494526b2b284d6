"""Places and boxes of crowded frames: the results of comparing every pair, without the pairs."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import cells, identity, labels

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def crowd(spark, n_boxes, n_reads, seed, frames=2):
    r = random.Random(seed)
    at = lambda w, h: (x := r.randint(0, 800) / 10, y := float(r.randint(0, 40)), x + w, y + h)
    boxes = [(0, r.randrange(frames), i % 50, i, at(r.choice([8, 20, 60]), 20)) for i in range(n_boxes)]
    reads = [(0, r.randrange(frames), i, at(r.choice([0, 3, 6]), 6), str(i % 10)) for i in range(n_reads)]
    b = spark.createDataFrame(boxes, f"clip_id int, frame int, track_id long, ord long, box {BOX}")
    return b, spark.createDataFrame(reads, f"clip_id int, frame int, read_id long, box {BOX}, number string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("seed", "n_boxes"), [(0, 3), (1, 300), (2, 900)])
@pytest.mark.parametrize("least", [0.0, 0.5, 0.9])
def test_reads_go_to_the_box_that_every_pair_gives(spark, seed, n_boxes, least):
    b, r = crowd(spark, n_boxes, 300, seed)
    met = r.join(b.select("clip_id", "frame", "track_id", "ord", F.col("box").alias("_b")), ["clip_id", "frame"]).withColumn("s", g.ios(F.col("box"), F.col("_b"))).where(F.col("s") >= least)
    want = met.groupBy("clip_id", "frame", "read_id").agg(F.max(F.struct(F.round("s", 9), "ord", "track_id", "number")).alias("m")).select("clip_id", "m.track_id", "frame", "read_id", "m.number")
    assert rows(identity.match_reads(r, b, least)) == rows(want)


@pytest.mark.parametrize(("seed", "n_boxes"), [(0, 3), (1, 900)])
def test_points_and_players_as_every_pair_gives(spark, seed, n_boxes):
    b, r = crowd(spark, n_boxes, 300, seed)
    p = r.select("clip_id", "frame", "read_id", F.col("box.x1").alias("px"), F.col("box.y1").alias("py"))
    met = p.join(b, ["clip_id", "frame"]).where(g.contains(F.col("box"), F.col("px"), F.col("py")))
    best = met.groupBy("read_id").agg(F.min(F.struct(g.area(F.col("box")).alias("a"), "ord")).alias("m"))
    assert rows(labels.box_at(b, p, ["clip_id", "frame"]).select("read_id", "ord")) == rows(p.select("read_id").join(best, "read_id", "left").select("read_id", "m.ord"))
    few = r.where("read_id < 20")
    c = g.center(F.col("box"))
    held = b.join(few.select("clip_id", "frame", c["x"].alias("x"), c["y"].alias("y")), ["clip_id", "frame"]).where(g.contains(F.col("box"), F.col("x"), F.col("y"))).select("ord")
    assert rows(identity.mined_abstentions(b, few, 2**31 - 1, 0).select("ord")) == rows(b.join(held, "ord", "left_anti").select("ord"))


def test_few_pairs_are_compared(spark):
    """Pairs that are compared in one frame of n boxes and n places; every pair would be n * n, so 16 times as many."""
    pairs = []
    for n in (2000, 8000):
        b, r = crowd(spark, n, n, 5, frames=1)
        e = F.col("box")
        r = cells.dealt(r, ["clip_id", "frame"], e["x1"], e["y1"], e["x2"], e["y2"])
        ranked = b.select("clip_id", "frame", e.alias("_b"), F.struct("ord").alias("_rank"))
        pairs.append(r.join(cells.contenders(r, ranked, ["clip_id", "frame"]), ["clip_id", "frame", "_cell"]).count())
    assert pairs[1] < 10 * pairs[0] and pairs[1] < 30 * 8000


def test_many_tracks_of_a_number_merge_in_time(spark):
    n = 40_000
    r = np.random.default_rng(3)
    start = r.integers(0, 30, n).tolist()
    s = spark.createDataFrame([(0, i, a, a + 2 + i % 4, i) for i, a in enumerate(start)], "clip_id int, track_id long, start int, end int, ord int")
    t = time.time()
    got = {x.track_id: x.canonical_id for x in identity.merge_by_number(s.select("clip_id", "track_id", F.lit("7").alias("number")), s).collect()}
    assert time.time() - t < 60
    at: dict = {}
    for i in sorted(range(n), key=lambda i: (start[i], i)):
        at.setdefault(got[i], []).append(i)
    assert len(got) == n and all(start[j] > start[i] + 2 + i % 4 for g_ in at.values() for i, j in zip(g_, g_[1:]))
