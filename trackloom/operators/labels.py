"""Edits of track labels as new versions, and profiles of label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import cells


class LabelVersions:
    """Label tables(frame, ord, gid, box) and their edits; undo goes back at most 200 versions.

    Every edit is a plan over the version before it, so nothing is copied until it is read.
    """

    LIMIT = 200

    def __init__(self, labels: DataFrame):
        self.now, self.past = labels, []

    def _edit(self, new: DataFrame) -> None:
        self.past = [*self.past, self.now][-self.LIMIT :]
        self.now = new

    def relabel(self, old: int, new: int) -> None:
        if old != new:
            self._edit(self.now.withColumn("gid", F.when(F.col("gid") == old, new).otherwise(F.col("gid"))))

    def override(self, frame: int, ord_: int, gid: int) -> None:
        here = (F.col("frame") == frame) & (F.col("ord") == ord_)
        self._edit(self.now.withColumn("gid", F.when(here, gid).otherwise(F.col("gid"))))

    def remove(self, gid: int) -> None:
        self._edit(self.now.filter(F.col("gid") != gid))

    def next_id(self) -> int:
        return (self.now.agg(F.max("gid")).first()[0] or 0) + 1

    def undo(self) -> bool:
        if not self.past:
            return False
        self.now = self.past.pop()
        return True


def box_at(boxes: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """points(…, px, py) with the ord of the smallest box that holds the point, the first of equals; null without one."""
    x, y, b = F.col("px"), F.col("py"), F.col("_b")
    dealt = cells.dealt(points, key, x, y, x, y)
    ranked = boxes.select(*key, F.col("box").alias("_b"), F.struct(g.area(F.col("box")).alias("a"), "ord").alias("_rank"))
    met = dealt.join(cells.contenders(dealt, ranked, key, F.min), [*key, "_cell"]).filter(g.contains(b, x, y))
    best = met.groupBy(*points.columns).agg(F.min("_rank").alias("m"))
    return points.join(best.select(*points.columns, F.col("m.ord").alias("ord")), points.columns, "left")


def label_profile(labels: DataFrame, few: int = 5) -> DataFrame:
    """One row: classes, rows, empty labels, smallest class, classes with under ``few`` rows, the five largest."""
    per = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("label") != ""
    return per.agg(
        F.count_if(named).alias("classes"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("empty"),
        F.min(F.when(named, F.col("n"))).alias("smallest"), F.count_if(named & (F.col("n") < few)).alias("rare"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(named, F.struct((-F.col("n")).alias("o"), "label")))), 1, 5), lambda x: x["label"]), ",").alias("top"),
    )


def box_sizes(boxes: DataFrame) -> DataFrame:
    """Median width and height per class."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return boxes.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.median(w).alias("median_w"), F.median(h).alias("median_h"))


def dataset_summary(images: DataFrame) -> DataFrame:
    """images(source, n_visible): images and mean visible keypoints per source."""
    return images.groupBy("source").agg(F.count(F.lit(1)).alias("images"), F.avg("n_visible").alias("mean_visible"))
