"""Tracklets and their greedy linking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class PixelRule:
    """Limits of linking in the image: frames, distance in mean heights, least similarity."""

    max_gap: float = 45
    max_factor: float = 2.5
    least_similarity: float = 0.5


@dataclass(frozen=True)
class CourtRule:
    """Limits of linking on the court: seconds, feet, feet a second, least similarity."""

    fps: float = 30.0
    max_gap_s: float = 1.5
    base_ft: float = 3.0
    max_speed: float = 25.0
    least_similarity: float = 0.5


def tracklets(boxes: DataFrame, features: DataFrame | None = None, key: str = "clip_id") -> DataFrame:
    """First and last frame, centre and height of each track, and its mean feature at unit length.

    boxes(clip, track_id, i, box, ord); features(clip, track_id, feature). Without features
    the feature is a single zero, which is like nothing.
    """
    c = g.center(F.col("box"))
    at = F.struct(c["x"].alias("x"), c["y"].alias("y"))
    out = boxes.groupBy(key, "track_id").agg(
        F.min("i").alias("start_frame"), F.max("i").alias("end_frame"),
        F.min_by(at, "i").alias("start_xy"), F.max_by(at, "i").alias("end_xy"),
        F.min_by(F.col("box.y2") - F.col("box.y1"), "i").alias("start_h"), F.max_by(F.col("box.y2") - F.col("box.y1"), "i").alias("end_h"),
        F.min("ord").alias("ord"),
    )
    zero = F.array(F.lit(0.0))
    if features is None:
        return out.withColumn("feature", zero)
    each = features.select(key, "track_id", F.posexplode("feature").alias("p", "v"))
    mean = each.groupBy(key, "track_id", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vec = mean.groupBy(key, "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("feature"))
    norm = F.sqrt(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(norm > 0, F.transform("feature", lambda x: x / norm)).otherwise(F.col("feature"))
    return out.join(vec.select(key, "track_id", unit.alias("feature")), [key, "track_id"], "left").withColumn("feature", F.coalesce("feature", zero))


def _similarity(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / n if n > 0 else 0.0


def _linked(pdf: pd.DataFrame, gate) -> pd.DataFrame:
    """Greedy linking of one clip's tracklets in order of their start.

    Every tracklet joins the open group with the best score, the first of equals. Groups
    keep the feature of their first member and the place and time of their last. Only groups
    whose end is recent enough are looked at: they are kept by end, and old ones retire.
    """
    rows = pdf.sort_values(["start_frame", "ord"], kind="stable").to_dict("records")
    groups: list[dict] = []
    open_: list[dict] = []
    for r in rows:
        best, top = None, -math.inf
        open_ = [q for q in open_ if gate.recent(r["start_frame"] - q["end"])]
        for q in open_:
            if (score := gate.score(q, r)) is not None and score > top:
                best, top = q, score
        if best is None:
            best = {"ids": [], "feature": r["feature"], "order": len(groups)}
            groups.append(best)
            open_.append(best)
        best["ids"].append(r["track_id"])
        best.update(end=r["end_frame"], x=r["end_xy"]["x"], y=r["end_xy"]["y"], h=r["end_h"])
    pairs = [(i, min(q["ids"])) for q in groups for i in q["ids"]]
    return pd.DataFrame(pairs, columns=["track_id", "canonical_id"])


class _Pixels:
    def __init__(self, rule: PixelRule):
        self.rule = rule

    def recent(self, gap: float) -> bool:
        return gap <= self.rule.max_gap

    def score(self, q: dict, r: dict) -> float | None:
        gap, scale = r["start_frame"] - q["end"], (q["h"] + r["start_h"]) / 2
        if not 0 < gap <= self.rule.max_gap or scale <= 0:
            return None
        reach = self.rule.max_factor * scale
        d = math.hypot(r["start_xy"]["x"] - q["x"], r["start_xy"]["y"] - q["y"])
        if d > reach:
            return None
        like = _similarity(q["feature"], r["feature"])
        return None if like < self.rule.least_similarity else like - 0.5 * d / reach - 0.5 * gap / self.rule.max_gap


class _Court:
    def __init__(self, rule: CourtRule):
        self.rule = rule

    def recent(self, gap: float) -> bool:
        return gap / self.rule.fps <= self.rule.max_gap_s

    def score(self, q: dict, r: dict) -> float | None:
        gap = r["start_frame"] - q["end"]
        gap_s = gap / self.rule.fps
        if gap <= 0 or gap_s > self.rule.max_gap_s:
            return None
        reach = self.rule.base_ft + self.rule.max_speed * gap_s
        d = math.hypot(r["start_xy"]["x"] - q["x"], r["start_xy"]["y"] - q["y"])
        if d > reach:
            return None
        like = _similarity(q["feature"], r["feature"])
        return None if like < self.rule.least_similarity else like - 0.5 * d / reach - 0.5 * gap_s / self.rule.max_gap_s


def link(found: DataFrame, rule: PixelRule | CourtRule, key: str = "clip_id") -> DataFrame:
    """(clip, track_id, canonical_id). The greedy order is inherent, so a clip (or segment) is one task's work."""
    kind, schema = found.schema[key].dataType.simpleString(), found.schema["track_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gate = _Court(rule) if isinstance(rule, CourtRule) else _Pixels(rule)
        return _linked(pdf, gate).assign(**{key: pdf[key].iloc[0]})[[key, "track_id", "canonical_id"]]

    cols = [key, "track_id", "start_frame", "end_frame", "start_xy", "end_xy", "feature", "ord"]
    for h in ("start_h", "end_h"):
        found = found if h in found.columns else found.withColumn(h, F.lit(1.0))
    return found.select(*cols, "start_h", "end_h").groupBy(key).applyInPandas(run, f"{key} {kind}, track_id {schema}, canonical_id {schema}")
