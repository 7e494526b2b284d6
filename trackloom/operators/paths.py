"""Movement along tracks: smoothing, differences, statistics, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

KEY = ["clip_id", "track_id"]


def smoothed(path: DataFrame, window: int = 5, key: list[str] = KEY) -> DataFrame:
    """path(…, t, ord, x, y) with sx, sy: centred row averages that shrink at the ends.

    Tracks of fewer than three rows, or windows under two, are left as they are.
    """
    half = window // 2
    w = Window.partitionBy(*key).orderBy("t", "ord")
    around, whole = w.rowsBetween(-half, half), Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(whole)
    plain = (n < 3) | F.lit(window < 2)
    return path.withColumns({f"s{c}": F.when(plain, F.col(c)).otherwise(F.avg(c).over(around)) for c in ("x", "y")})


def steps(path: DataFrame, cap: float = 32.0, key: list[str] = KEY, x: str = "sx", y: str = "sy") -> DataFrame:
    """path with step (feet), dt, speed, and ok: whether the step is one a person can make."""
    w = Window.partitionBy(*key).orderBy("t", "ord")
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in (x, y, "t"))
    return path.withColumns({"step": F.sqrt(dx * dx + dy * dy), "dt": dt}).withColumns({
        "speed": F.when(F.col("dt") > 0, F.col("step") / F.col("dt")),
    }).withColumn("ok", F.coalesce((F.col("dt") > 0) & (F.col("speed") <= cap), F.lit(False)))


def movement_stats(
    path: DataFrame, min_frames: int = 15, window: int = 5, top: float = 0.95, cap: float = 32.0, key: list[str] = KEY
) -> DataFrame:
    """Per track: team, frames, seconds, distance_ft, avg_speed_mph, top_speed_mph, unrounded.

    One shuffle by track serves the windows and the aggregate. The team is the most
    frequent one, null among them, and of equals the one seen first.
    """
    whole = Window.partitionBy(*key)
    long = path.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_frames)
    moved = steps(smoothed(long, window, key), cap, key)
    per_team = Window.partitionBy(*key, "team")
    voted = moved.withColumns({"_votes": F.count(F.lit(1)).over(per_team), "_seen": F.min(F.struct("t", "ord")).over(per_team)})
    w = Window.partitionBy(*key).orderBy(F.desc("_votes"), "_seen")
    voted = voted.withColumn("_team", F.first("team").over(w))
    out = voted.groupBy(*key).agg(
        F.first("_team").alias("team"),
        F.count(F.lit(1)).alias("frames"),
        (F.max("t") - F.min("t")).alias("seconds"),
        F.sum(F.when(F.col("ok"), F.col("step"))).alias("distance_ft"),
        F.percentile(F.when(F.col("ok"), F.col("speed")), top).alias("_top"),
        F.count_if("ok").alias("_ok"),
    )
    avg = F.when(F.col("seconds") > 0, F.col("distance_ft") / F.col("seconds")).otherwise(0.0)
    return out.filter("_ok > 0").select(
        *key, "team", "frames", "seconds", "distance_ft", (avg * g.MPH).alias("avg_speed_mph"), (F.col("_top") * g.MPH).alias("top_speed_mph")
    )


def present(stats: DataFrame, places: int = 1) -> DataFrame:
    """Rounded for reading, longest distance first."""
    cols = ["seconds", "distance_ft", "avg_speed_mph", "top_speed_mph"]
    out = stats.withColumns({c: F.round(c, places) for c in cols if c in stats.columns})
    return out.orderBy(F.desc("distance_ft"), *[c for c in KEY if c in out.columns])


def court_positions(boxes: DataFrame, homography: Column, fps: Column, margin: float = 2.0, full: bool = False) -> DataFrame:
    """Foot points of boxes(…, frame, box, ord, team) on the court, in bounds only."""
    f = g.foot(F.col("box"))
    out = boxes.withColumn("_p", g.project(homography, f["x"], f["y"]))
    x, y = F.col("_p.x"), F.col("_p.y")
    inside = g.in_full_court(x, y, margin) if full else g.in_half_court(x, y, margin)
    return out.filter(inside).withColumns({"x": x, "y": y, "t": g.seconds(F.col("frame"), fps)}).drop("_p")


def player_stats(boxes: DataFrame, homography: Column, fps: Column, **kw) -> DataFrame:
    """Movement statistics of a static camera."""
    return movement_stats(court_positions(boxes, homography, fps), **kw)


def occupancy(path: DataFrame, width: int = 50, length: int = 47, by: list[str] | None = None) -> DataFrame:
    """Counts per one-foot cell (bx, by_); points on the upper edges belong to the last cells, others outside to none."""
    x, y = F.col("x"), F.col("y")
    inside = path.filter(x.between(0, width) & y.between(0, length))
    return inside.groupBy(
        *(by or []), F.least(F.floor(x), F.lit(width - 1)).cast("int").alias("bx"), F.least(F.floor(y), F.lit(length - 1)).cast("int").alias("by_")
    ).agg(F.count(F.lit(1)).alias("n"))


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian at whole steps, out to truncate sigmas."""
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def smoothed_occupancy(cells: DataFrame, width: int = 50, length: int = 47, sigma: float = 1.2) -> DataFrame:
    """cells blurred by a Gaussian whose tails are mirrored at the edges; the kernel is a constant of a few dozen steps."""
    w = kernel(sigma)
    r = len(w) // 2

    def spread(df: DataFrame, axis: str, size: int) -> DataFrame:
        step = F.explode(F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(v).alias("w")) for k, v in enumerate(w)])).alias("s")
        other = "by_" if axis == "bx" else "bx"
        moved = F.pmod(F.col(axis) + F.col("s.d"), F.lit(2 * size))
        cell = F.when(moved >= size, 2 * size - 1 - moved).otherwise(moved).cast("int")
        return df.select("bx", "by_", "n", step).groupBy(cell.alias(axis), other).agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))

    return spread(spread(cells, "bx", width), "by_", length)
