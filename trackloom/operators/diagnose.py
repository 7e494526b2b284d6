"""Tracking health without labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def life(boxes: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per track: first and last ordinal, boxes, and where it was born and died. boxes(clip, i, track_id, box)"""
    c = g.center(F.col("box"))
    at = F.struct(c["x"].alias("x"), c["y"].alias("y"))
    return boxes.groupBy(key, "track_id").agg(
        F.min("i").alias("born"), F.max("i").alias("died"), F.count(F.lit(1)).alias("hits"), F.min_by(at, "i").alias("birth"), F.max_by(at, "i").alias("death")
    )


def switches(lives: DataFrame, frames: DataFrame, gap: int = 5, reach: float = 60.0, key: str = "clip_id") -> DataFrame:
    """(clip, id_switch_proxy): deaths before the last frame with another track born soon after and close by.

    frames(clip, n_frames). The range condition becomes an equi-join on cells of ``gap`` frames.
    """
    cell = lambda c: F.floor(F.col(c) / gap).cast("long")
    dead = lives.join(frames, key).filter(F.col("died") < F.col("n_frames") - 1)
    d = dead.select(key, F.col("track_id").alias("dead_id"), "died", "death", F.explode(F.array(cell("died"), cell("died") + 1)).alias("cell"))
    b = lives.select(key, F.col("track_id").alias("born_id"), "born", "birth", cell("born").alias("cell"))
    dx, dy = F.col("birth.x") - F.col("death.x"), F.col("birth.y") - F.col("death.y")
    soon = (F.col("born") - F.col("died")).between(1, gap)
    hit = d.join(b, [key, "cell"]).filter(soon & (F.col("dead_id") != F.col("born_id")) & (dx * dx + dy * dy <= reach * reach))
    counted = hit.select(key, "dead_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_s"))
    return frames.select(key).join(counted, key, "left").select(key, F.coalesce("_s", F.lit(0)).alias("id_switch_proxy"))


def diagnose(boxes: DataFrame, frames: DataFrame, fps: float, warmup_s: float = 1.0, gap: int = 5, reach: float = 60.0, key: str = "clip_id") -> DataFrame:
    """One row per clip of frames(clip, n_frames) with the health metrics, unrounded; frames without boxes count as 0."""
    lives = life(boxes, key)
    w = Window.partitionBy(key).orderBy("hits", "track_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = lives.withColumns({"_r": F.row_number().over(w) - 1, "_m": n})
    per = ranked.groupBy(key).agg(
        F.sum("hits").alias("total_boxes"), F.count(F.lit(1)).alias("unique_ids"), F.avg("hits").alias("track_len_mean"), F.median("hits").alias("track_len_median"),
        F.max(F.when(F.col("_r") == F.floor(0.9 * (F.col("_m") - 1)), F.col("hits"))).alias("track_len_p90"),
        F.count_if(F.col("born") > warmup_s * fps).alias("new_ids_after_warmup"),
    )
    # the median over all frames, those without boxes at zero, from the counts of the others
    each = boxes.groupBy(key, "i").agg(F.count(F.lit(1)).alias("c"))
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs")).join(frames, key, "right")
    cs, size = F.coalesce("cs", F.array().cast("array<bigint>")), F.col("n_frames")
    empty = size - F.size(cs)
    item = lambda k: F.when(k < empty, F.lit(0)).otherwise(F.coalesce(F.get(cs, (k - empty).cast("int")), F.lit(0)))
    med = (item(F.floor((size - 1) / 2)) + item(F.floor(size / 2))) / 2.0
    out = lists.select(key, "n_frames", F.when(size > 0, med).otherwise(0.0).alias("median_simultaneous")).join(per, key, "left")
    zero = ["total_boxes", "unique_ids", "track_len_mean", "track_len_median", "track_len_p90", "new_ids_after_warmup"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).join(switches(lives, frames, gap, reach, key), key)
    return out.withColumns({
        "fragmentation_ratio": F.coalesce(F.try_divide(F.col("unique_ids"), F.col("median_simultaneous")), F.lit(0.0)),
        "track_len_median_s": F.col("track_len_median") / fps if fps else F.lit(0.0),
    })
