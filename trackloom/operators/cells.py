"""Pairing what lies in a frame with the boxes there, without comparing every pair.

The places of a frame are dealt to a grid over its extent. A box that holds all that lies in a cell outdoes, for everything
there, the boxes of lower rank, so only the few of higher rank are compared; for a cell that no box holds, all that touch it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 16


def _index(v: str) -> Column:
    share = (F.col(f"_{v}1") - F.col(f"_lo{v}")) / F.nullif(F.col(f"_hi{v}") - F.col(f"_lo{v}"), F.lit(0.0)) * GRID
    return F.least(F.coalesce(F.floor(share).cast("int"), F.lit(0)), F.lit(GRID - 1))


def dealt(places: DataFrame, key: list[str], x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """places with _cell, their number in the grid of their frame, and their extent _x1, _y1, _x2, _y2."""
    rows = places.withColumns({k: v.cast("double") for k, v in (("_x1", x1), ("_y1", y1), ("_x2", x2), ("_y2", y2))})
    ends = [f(f"_{v}1").alias(f"_{n}{v}") for v in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.join(rows.groupBy(*key).agg(*ends), key).withColumn("_cell", _index("x") * GRID + _index("y")).drop("_lox", "_hix", "_loy", "_hiy")


def extents(places: DataFrame, key: list[str]) -> DataFrame:
    """(key, _cell, _x1, _y1, _x2, _y2) of the cells of dealt() that hold any place: at most GRID * GRID a frame."""
    return places.groupBy(*key, "_cell").agg(F.min("_x1").alias("_x1"), F.min("_y1").alias("_y1"), F.max("_x2").alias("_x2"), F.max("_y2").alias("_y2"))


def holds(b: Column) -> Column:
    """Whether a box holds all of a cell's extent."""
    return (b["x1"] <= F.col("_x1")) & (b["y1"] <= F.col("_y1")) & (b["x2"] >= F.col("_x2")) & (b["y2"] >= F.col("_y2"))


def touches(b: Column) -> Column:
    return (b["x1"] <= F.col("_x2")) & (b["y1"] <= F.col("_y2")) & (b["x2"] >= F.col("_x1")) & (b["y2"] >= F.col("_y1"))


def contenders(places: DataFrame, boxes: DataFrame, key: list[str], best: Callable = F.max) -> DataFrame:
    """(key, _cell, _b, _rank): for the places of dealt(), the boxes(key, _b, _rank) that may be the best of one of them.

    best is F.max or F.min of _rank. Of equal boxes of a frame the best ranked stands for all.
    """
    cells = extents(places, key)
    boxes = boxes.groupBy(*key, "_b").agg(best("_rank").alias("_rank"))
    b = F.col("_b")
    held = boxes.join(cells, key).where(holds(b)).groupBy(*key, "_cell").agg(best("_rank").alias("_top"))
    cells = cells.join(held, [*key, "_cell"], "left")
    ahead = F.col("_rank") >= F.col("_top") if best is F.max else F.col("_rank") <= F.col("_top")
    return boxes.join(cells, key).where(touches(b) & (F.col("_top").isNull() | ahead)).select(*key, "_cell", "_b", "_rank")
