"""Camera motion between frames: similarity transforms from point correspondences with outliers.

Everything is column expressions over one row per frame, so frames are independent and no Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@dataclass(frozen=True)
class ConsensusRule:
    """threshold: pixels within which a pair agrees with a transform; draws: hypotheses of two pairs each; least: pairs that must agree."""

    threshold: float = 3.0
    draws: int = 64
    least: int = 6


def _one(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _similarity(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), tx.alias("tx"), ty.alias("ty"))


def _through(p: Column, q: Column) -> Column:
    """The similarity that maps two points as their pairs say; null if they coincide."""
    dx, dy, du, dv = q["x"] - p["x"], q["y"] - p["y"], q["u"] - p["u"], q["v"] - p["v"]
    n = F.nullif(dx * dx + dy * dy, F.lit(0.0))

    def placed(m: Column) -> Column:
        return _similarity(m["a"], m["b"], p["u"] - m["a"] * p["x"] + m["b"] * p["y"], p["v"] - m["b"] * p["x"] - m["a"] * p["y"])

    return _one(F.struct(((dx * du + dy * dv) / n).alias("a"), ((dx * dv - dy * du) / n).alias("b")), placed)


def _agrees(m: Column, p: Column, threshold: float) -> Column:
    eu = m["a"] * p["x"] - m["b"] * p["y"] + m["tx"] - p["u"]
    ev = m["b"] * p["x"] + m["a"] * p["y"] + m["ty"] - p["v"]
    return F.coalesce(eu * eu + ev * ev <= threshold * threshold, F.lit(False))


def _refit(points: Column) -> Column:
    """The least-squares similarity of point pairs, from their sums about the means; null if all points coincide."""
    n = F.size(points).cast("double")
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / n

    def fitted(m: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("xx", "dot", "cross")])

        def add(s: Column, p: Column) -> Column:
            x, y, u, v = (p[c] - m[c] for c in "xyuv")
            return F.struct((s["xx"] + x * x + y * y).alias("xx"), (s["dot"] + x * u + y * v).alias("dot"), (s["cross"] + x * v - y * u).alias("cross"))

        def placed(s: Column) -> Column:
            size = F.nullif(s["xx"], F.lit(0.0))
            a, b = s["dot"] / size, s["cross"] / size
            return _similarity(a, b, m["u"] - a * m["x"] + b * m["y"], m["v"] - b * m["x"] - a * m["y"])

        return _one(F.aggregate(points, zero, add), placed)

    return _one(F.struct(*[mean(c).alias(c) for c in "xyuv"]), fitted)


def camera_affines(matches: DataFrame, rule: ConsensusRule = ConsensusRule()) -> DataFrame:
    """(clip_id, frame, affine, inliers): the row-major 2x3 similarity from (x, y) to (u, v) of each frame.

    matches(clip_id, frame, i, x, y, u, v): i numbers the pairs of a frame, a few hundred at most. Each hypothesis is
    drawn by a hash of frame and draw, so every run draws the same; the one that most pairs agree with (the first of
    equals) is fitted again to those pairs. Frames in which under ``least`` pairs agree get the identity.
    """
    ok = F.col("x") + F.col("y") + F.col("u") + F.col("v")
    pair = F.struct("i", *[F.col(c).cast("double").alias(c) for c in "xyuv"])
    rows = matches.where(ok.isNotNull() & ~F.isnan(ok)).groupBy("clip_id", "frame").agg(F.sort_array(F.collect_list(pair)).alias("pts"))
    n = F.size("pts")

    def drawn(d: Column) -> Column:
        first = F.pmod(F.xxhash64(F.col("clip_id"), F.col("frame"), d, F.lit(0)), n.cast("long")).cast("int")
        step = F.pmod(F.xxhash64(F.col("clip_id"), F.col("frame"), d, F.lit(1)), F.greatest(n - 1, F.lit(1)).cast("long")).cast("int") + 1
        return _one(F.struct(first.alias("p"), ((first + step) % n).alias("q")), lambda k: _through(F.get("pts", k["p"]), F.get("pts", k["q"])))

    def scored(d: Column) -> Column:
        count = lambda m: F.size(F.filter("pts", lambda p: _agrees(m, p, rule.threshold)))
        return _one(drawn(d), lambda m: F.struct(count(m).alias("n"), (-d).alias("d"), m.alias("m")))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(rule.draws - 1)), scored))
    rows = rows.withColumn("_best", best)
    rows = rows.withColumn("_in", F.filter("pts", lambda p: _agrees(F.col("_best.m"), p, rule.threshold)))
    rows = rows.withColumn("_fit", F.when(F.size("_in") >= rule.least, _refit(F.col("_in"))))
    f = F.col("_fit")
    affine = F.array(f["a"], -f["b"], f["tx"], f["b"], f["a"], f["ty"])
    still = F.array(*[F.lit(v) for v in IDENTITY])
    return rows.select("clip_id", "frame", F.when(f["a"].isNotNull(), affine).otherwise(still).alias("affine"), F.size("_in").alias("inliers"))
