"""Jersey numbers: matching reads to tracks, voting, merging disjoint spans."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import cells


def match_reads(reads: DataFrame, boxes: DataFrame, min_ios: float = 0.9, key: str = "clip_id") -> DataFrame:
    """(clip, track_id, frame, read_id, number): each read goes to the box of its frame that holds it best.

    The threshold is inclusive and of equal boxes the last listed wins; reads without a box drop out.
    """
    frame, rank = [key, "frame"], F.struct(F.col("ord").alias("_o"), "track_id")
    b = boxes.select(*frame, F.col("box").alias("_b"), rank.alias("_rank"))
    if min_ios > 0:
        # a read that lies in a box as a whole has the greatest share, 1, so there the last listed such box wins
        r = F.col("box")
        reads = cells.dealt(reads.where(g.area(r) > 0), frame, r["x1"], r["y1"], r["x2"], r["y2"])
        pairs = reads.join(cells.contenders(reads, b, frame), [*frame, "_cell"])
    else:
        pairs = reads.join(b, frame)
    met = pairs.withColumn("_s", g.ios(F.col("box"), F.col("_b"))).filter(F.col("_s") >= min_ios)
    # equal up to rounding counts as equal
    best = met.groupBy(*frame, "read_id").agg(F.max(F.struct(F.round("_s", 9), "_rank", "number")).alias("m"))
    return best.select(key, F.col("m._rank.track_id").alias("track_id"), "frame", "read_id", F.col("m.number").alias("number"))


def without_abstentions(reads: DataFrame, label: str = "unreadable") -> DataFrame:
    return reads.filter(F.col("number") != label)


def confirm_numbers(votes: DataFrame, min_votes: int = 3, min_share: float = 0.5, key: str = "clip_id") -> DataFrame:
    """(clip, track_id, number, n, total): the plurality number, first seen among equals, if it has the votes."""
    per = votes.groupBy(key, "track_id", "number").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("frame", "read_id")).alias("seen"))
    w = Window.partitionBy(key, "track_id")
    ranked = per.withColumns({"total": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "seen"))})
    sure = (F.col("_r") == 1) & (F.col("total") >= min_votes) & (F.col("n") >= min_votes) & (F.col("n") >= min_share * F.col("total"))
    return ranked.filter(sure).select(key, "track_id", "number", "n", "total")


def _merged(pdf: pd.DataFrame) -> dict:
    """Track ids and the smallest id of their group, for the tracks of one number.

    Starts never fall, so a group that has ended before one start has ended before all later ones: those that still run
    wait in a heap by their end, the free ones in a heap by their number.
    """
    rows = pdf.sort_values(["start", "ord", "end", "track_id"], kind="stable", na_position="first")
    least, ends, at, free, running = [], [], [], [], []
    for start, end, track in zip(rows["start"], rows["end"], rows["track_id"], strict=True):
        while running and running[0][0] < start:
            heapq.heappush(free, heapq.heappop(running)[1])
        if free and not pd.isna(start):
            k = heapq.heappop(free)
            least[k], ends[k] = min(least[k], track), ends[k] if pd.isna(end) else max(ends[k], end)
        else:
            k = len(least)
            least.append(track), ends.append(end)
        if not pd.isna(ends[k]):  # one without an end takes no other
            heapq.heappush(running, (ends[k], k))
        at.append(k)
    return {"track_id": rows["track_id"].to_numpy(), "canonical_id": [least[k] for k in at]}


def merge_by_number(confirmed: DataFrame, spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """(clip, track_id, canonical_id): tracks of one number join the first group that ends before they start.

    spans(clip, track_id, start, end, ord). Tracks without a number stand for themselves.
    """
    long = [F.col(c).cast("long").alias(c) for c in ("track_id", "start", "end")]
    t = confirmed.select(key, "track_id", "number").join(spans, [key, "track_id"]).select(key, "number", *long, "ord")
    kind = t.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[0], **_merged(pdf)})

    merged = t.groupBy(key, "number").applyInPandas(run, f"{key} {kind}, track_id long, canonical_id long")
    rest = spans.select(key, F.col("track_id").cast("long").alias("track_id")).join(merged, [key, "track_id"], "left_anti")
    return merged.unionByName(rest.withColumn("canonical_id", F.col("track_id")))


def identify(reads: DataFrame, boxes: DataFrame, spans: DataFrame, key: str = "clip_id", **kw) -> tuple[DataFrame, DataFrame]:
    """(remap, numbers of canonical tracks)"""
    votes = match_reads(reads, boxes, kw.pop("min_ios", 0.9), key)
    confirmed = confirm_numbers(votes, kw.pop("min_votes", 3), kw.pop("min_share", 0.5), key)
    remap = merge_by_number(confirmed, spans, key)
    numbers = confirmed.join(remap, [key, "track_id"]).select(key, F.col("canonical_id").alias("track_id"), "number").distinct()
    return remap, numbers


def remapped(df: DataFrame, remap: DataFrame, key: str = "clip_id") -> DataFrame:
    """df with track ids replaced by their canonical ones."""
    out = df.join(remap.select(key, "track_id", "canonical_id"), [key, "track_id"], "left")
    return out.withColumn("track_id", F.coalesce("canonical_id", "track_id")).drop("canonical_id")


def remapped_spans(spans: DataFrame, remap: DataFrame, key: str = "clip_id") -> DataFrame:
    out = remapped(spans, remap, key)
    return out.groupBy(key, "track_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord"))


def spans_of(boxes: DataFrame, key: str = "clip_id") -> DataFrame:
    """First and last frame of each track."""
    return boxes.groupBy(key, "track_id").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.min("ord").alias("ord"))


def telemetry(reads: DataFrame, votes: DataFrame, numbers: DataFrame, spans: DataFrame, paths: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row per clip: track counts, read rate, vote counts, read histogram, duplicated numbers."""
    per_track = votes.groupBy(key, "track_id").agg(F.count(F.lit(1)).alias("v"))
    v = per_track.groupBy(key).agg(F.count(F.lit(1)).alias("tracks_with_any_read"), F.max("v").alias("max_votes"), F.median("v").alias("median_votes"))
    i = numbers.groupBy(key).agg(F.countDistinct("track_id").alias("tracks_identified"))
    m = paths.groupBy(key).agg(F.countDistinct("track_id").alias("tracks_after_merge"))
    out = spans.groupBy(key).agg(F.countDistinct("track_id").alias("tracks_after_stitch"))
    for d in (m, i, v):
        out = out.join(d, key, "left")
    out = out.join(read_histogram(reads, key), key, "left").join(duplicated_numbers(numbers, key).groupBy(key).agg(F.count(F.lit(1)).alias("duplicated_numbers")), key, "left")
    counts = ["tracks_after_merge", "tracks_identified", "tracks_with_any_read", "max_votes", "duplicated_numbers"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("median_votes", F.coalesce("median_votes", F.lit(0.0)))
    return out.withColumn("read_rate", F.col("tracks_identified") / F.greatest(F.col("tracks_after_stitch"), F.lit(1)))


def read_histogram(reads: DataFrame, key: str = "clip_id") -> DataFrame:
    """Numbers by how often they were read, as number=count, most frequent first."""
    n = reads.groupBy(key, "number").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "number", "n")))
    return n.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["number"], x["n"].cast("string"))), ",").alias("read_histogram"))


def duplicated_numbers(numbers: DataFrame, key: str = "clip_id") -> DataFrame:
    """Numbers confirmed on more than one player at once."""
    return numbers.groupBy(key, "number").agg(F.countDistinct("track_id").alias("players")).filter("players > 1")


def duplicates_over_segments(dups: DataFrame) -> DataFrame:
    return dups.groupBy("number").agg(F.max("players").alias("players"))


def mined_abstentions(players: DataFrame, numbers: DataFrame, limit: int, seed: int, key: list[str] = ["clip_id", "frame"]) -> DataFrame:  # noqa: B006
    """Players in whose box no number has its centre: training material for 'unreadable', a seeded draw of at most limit.

    A box that holds all of a cell's centres is settled by that; only the others are compared with centres. The greatest
    limit that Spark takes asks for all, which needs no draw.
    """
    c, b = g.center(F.col("box")), F.col("box")
    n = cells.dealt(numbers.select(*key, c.alias("_c")), key, c_x := F.col("_c.x"), c_y := F.col("_c.y"), c_x, c_y)
    places = cells.extents(n, key)
    distinct = players.select(*key, "box").distinct()
    sure = distinct.join(places, key).where(cells.holds(b)).select(*key, "box").distinct()
    rest = distinct.join(sure, [*key, "box"], "left_anti")
    near = rest.join(places, key).where(cells.touches(b)).select(*key, "_cell", "box")
    hit = near.join(n, [*key, "_cell"]).where(g.contains(b, c_x, c_y)).select(*key, "box").distinct()
    left = players.join(sure.unionByName(hit), [*key, "box"], "left_anti")
    return left if limit >= 2**31 - 1 else left.orderBy(F.rand(seed)).limit(limit)
