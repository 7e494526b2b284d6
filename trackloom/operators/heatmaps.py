"""Boxes from the heat map of a centre-point detector, given as a table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def peaks(cells: DataFrame, top: int = 64, least: float = 0.3, stride: int = 4, key: str = "image_id") -> DataFrame:
    """(image, x, y, score, box) of cells(image, x, y, score, w, h, dx, dy) that no neighbour outdoes.

    A cell is a peak if none of the eight around it scores more; equal neighbours are peaks both. Of each image the
    ``top`` best peaks of at least ``least`` stay. Every cell tells its score to its neighbours, where the maxima are
    combined before the shuffle; cells may be missing anywhere.
    """
    near = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    best_near = cells.select(key, near.alias("n"), "score").groupBy(key, F.col("n.x").alias("x"), F.col("n.y").alias("y")).agg(F.max("score").alias("_m"))
    strong = cells.filter(F.col("score") >= least)
    found = strong.join(best_near, [key, "x", "y"]).filter(F.col("score") >= F.col("_m")).drop("_m")
    best = Window.partitionBy(key).orderBy(F.desc("score"), "y", "x")
    found = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top)
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    size = lambda c: F.greatest(F.col(c), F.lit(0.0)) * stride
    box = g.from_center((F.col("x") + unit("dx")) * stride, (F.col("y") + unit("dy")) * stride, size("w"), size("h"))
    return found.select(key, "x", "y", "score", box.alias("box"))
