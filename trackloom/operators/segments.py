"""Registered stretches of a clip from coarse samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(samples: DataFrame, fps: Column, min_len_s: float = 8.0, max_gap_s: float = 2.0, key: str = "clip_id") -> DataFrame:
    """(clip, start_frame, end_frame, duration_s) from samples(clip, frame, registered).

    A stretch ends only where a failed sample lies more than max_gap_s after the last
    good one; a pause without samples does not end it. Equal frames: failed ones first.
    """
    w = Window.partitionBy(key).orderBy("frame", "registered")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("registered")
    seen = samples.withColumns({
        "_good": F.max(F.when(ok, F.col("frame"))).over(past),
        "_bad": F.max(F.when(~ok, F.col("frame"))).over(past),
    })
    broken = (F.col("_bad") > F.col("_good")) & ((F.col("_bad") - F.col("_good")) / fps > max_gap_s)
    good = seen.filter(ok).withColumn("_break", F.coalesce(broken, F.lit(False)).cast("int"))
    run = good.withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(key, "_run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.first(fps).alias("_fps"))
    out = out.withColumn("duration_s", (F.col("end_frame") - F.col("start_frame")) / F.col("_fps"))
    return out.filter(F.col("duration_s") >= min_len_s).drop("_run", "_fps")


def coverage(samples: DataFrame, key: str = "clip_id") -> DataFrame:
    """Share of registered samples."""
    return samples.groupBy(key).agg(F.coalesce(F.avg(F.col("registered").cast("int")), F.lit(0.0)).alias("coverage"))


def analysable(segs: DataFrame, key: str = "clip_id", places: int = 1) -> DataFrame:
    """Seconds in segments, from durations that are rounded first."""
    return segs.groupBy(key).agg(F.sum(F.round("duration_s", places)).alias("analysable_s"), F.count(F.lit(1)).alias("n_segments"))


def true_runs(mask: DataFrame, least: int = 2, key: str = "clip_id") -> DataFrame:
    """(clip, start, end) of runs of true values in mask(clip, i, on), of at least ``least`` rows."""
    w = Window.partitionBy(key).orderBy("i")
    on = mask.withColumn("_r", F.row_number().over(w)).filter("on")
    on = on.withColumn("_g", F.col("_r") - F.row_number().over(w))
    return on.groupBy(key, "_g").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_g")


def sampled(frames: DataFrame, fps: float, sample_fps: float = 1.0) -> DataFrame:
    """The frames of a coarse pass: every round(fps / sample_fps)-th."""
    return frames.filter(F.col("frame") % max(1, round(fps / sample_fps)) == 0)


def window_frames(frames: DataFrame, fps: float, start_s: float, seconds: float, stride: int = 1) -> DataFrame:
    """A time window of a clip; ``i`` counts from its start and skips all but every stride-th frame."""
    first = int(start_s * fps)
    out = frames.filter((F.col("frame") >= first) & (F.col("frame") < first + int(seconds * fps)))
    return out.withColumn("i", F.col("frame") - first).filter(F.col("i") % stride == 0)


def read_frames(frames: DataFrame, every: int, key: str = "clip_id") -> DataFrame:
    """Of the analysed frames the first of every ``every``."""
    w = Window.partitionBy(key).orderBy("frame")
    return frames.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % every == 0).drop("_n")


def first_frames(frames: DataFrame, stride: int = 1, max_frames: int | None = None, key: str = "clip_id") -> DataFrame:
    """Every stride-th frame by its number, of each clip the first max_frames of these."""
    kept = frames.filter(F.col("frame") % stride == 0)
    if max_frames is None:
        return kept
    w = Window.partitionBy(key).orderBy("frame")
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_frames).drop("_r")
