"""Joins of refinement, whose sides hold many rows to a frame."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE
from trackloom.operators import refinement
from trackloom.plans import perception


def test_neither_samples_nor_pixels_are_broadcast(spark):
    frame = "clip_id long, frame long"
    points = spark.createDataFrame([(1, 1, 0, i, 10.0 * i, 0.0) for i in range(3)], f"{frame}, curve int, i int, fx double, fy double")
    pixels = spark.createDataFrame([(1, 1, 10, 2, 20)], f"{frame}, px int, py int, gray int")
    params = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])], f"{frame}, p array<double>")
    rule = refinement.RefineRule()
    found = refinement.matched(points, pixels, params, rule)
    assert [(r.fx, r.tx, r.ty) for r in found.collect()] == [(10.0, 10.0, 2.0)]
    for df in (found, refinement.normal_equations(found, params, rule)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_rounds_shuffle_nothing(spark):
    """Whatever the rounds, a frame's tables meet once; the result is that of the steps over tables."""
    points, pixels, corners, cams = perception._refine_tables(spark, SMOKE)
    first = cams.select("clip_id", "frame", F.col("first").alias("p"))
    rule = refinement.RefineRule(rounds=1, steps=1)
    plans = [refinement.refine(points, pixels, corners, first, refinement.RefineRule(rounds=k))._jdf.queryExecution().executedPlan().toString() for k in (1, 5)]
    assert len({p.count("Exchange hashpartitioning(clip_id") for p in plans}) == 1
    exchanges = [x for x in plans[0].split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and not any("px" in x or "curve" in x for x in exchanges)
    targets = refinement.matched(points, pixels, first, rule).unionByName(refinement.anchors(corners, rule))
    want = {r.clip_id: r.p for r in refinement.solved(refinement.normal_equations(targets, first, rule), rule).collect()}
    got = {r.clip_id: r.p for r in refinement.refine(points, pixels, corners, first, rule).collect()}
    assert len(got) > 5 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
