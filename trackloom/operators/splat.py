"""Training targets of a centre-point detector as tables, and its loss.

A heat map is a table of the cells that are not zero. Boxes are exploded to the cells within their radius
and cells are merged by their maximum, which combines before the shuffle, so an image with any number of
boxes is no one task's work.

Where predictions follow from the cell, grid_loss() gathers the peaks of an image, at most one a cell, and lays the cells out
within its row, so that what is shuffled grows with the boxes and not with the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Cells that are laid out at a time in a task.
CELLS = 1 << 18


def splat_radius(height: Column, width: Column, least: float = 0.7) -> Column:
    """The radius, 1 at least, within which a box moved by it still has an IoU of ``least`` with the true one.

    The least of three bounds: both corners moved the same way, both moved inwards, both moved outwards. As in the training
    code that such detectors share, the last two roots are not divided by their leading coefficients.
    """
    s, p = height + width, height * width
    root = lambda b, c, a=1.0: (b - F.sqrt(b * b - 4 * a * c)) / 2
    same = root(s, p * ((1 - least) / (1 + least)))
    inner = root(2 * s, p * (1 - least), 4.0)
    b = -2 * least * s
    outer = (b + F.sqrt(b * b + 16 * least * (1 - least) * p)) / 2
    return F.greatest(F.lit(1.0), F.least(same, inner, outer))


def targets(boxes: DataFrame, grid: int) -> DataFrame:
    """boxes(image_id, cx, cy, w, h), as parts of the image, with what their peak cell learns: (ix, iy, radius, w, h, dx, dy), in cells."""
    c = {k: F.col(k) * grid for k in ("cx", "cy", "w", "h")}
    rows = boxes.select(*[x for x in boxes.columns if x not in c], *[v.alias(k) for k, v in c.items()])
    rows = rows.withColumns({"ix": F.least(F.floor("cx"), F.lit(grid - 1)).cast("int"), "iy": F.least(F.floor("cy"), F.lit(grid - 1)).cast("int")})
    rows = rows.withColumns({"radius": F.floor(splat_radius(F.col("h"), F.col("w"))).cast("int"), "dx": F.col("cx") - F.col("ix"), "dy": F.col("cy") - F.col("iy")})
    return rows.where((F.col("ix") >= 0) & (F.col("iy") >= 0)).drop("cx", "cy")


def heat_cells(peaks: DataFrame, grid: int) -> DataFrame:
    """(image_id, ix, iy, heat): the cells around the peaks(image_id, ix, iy, radius), the greatest value where several reach."""
    r = F.col("radius")
    span = F.sequence(-r, r)
    rows = peaks.select("image_id", "ix", "iy", "radius", F.explode(span).alias("_dx")).select("*", F.explode(span).alias("_dy"))
    sigma = (2 * r + 1) / F.lit(6.0)
    heat = F.exp(-(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / (2 * sigma * sigma))
    cells = rows.select("image_id", (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy"), heat.alias("heat"))
    inside = (F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < grid) & (F.col("iy") < grid)
    return cells.where(inside).groupBy("image_id", "ix", "iy").agg(F.max("heat").alias("heat"))


def peak_cells(peaks: DataFrame, order: str) -> DataFrame:
    """One peak a cell: of several boxes with their centre in a cell the last one by ``order``."""
    values = F.struct("w", "h", "dx", "dy")
    return peaks.groupBy("image_id", "ix", "iy").agg(F.max_by(values, order).alias("v")).select("image_id", "ix", "iy", "v.*")


def detection_loss(cells: DataFrame, heat: DataFrame, peaks: DataFrame, size_weight: float = 0.1, offset_weight: float = 1.0) -> DataFrame:
    """One row (total, heatmap, wh, offset): the penalty-reduced focal loss and the L1 losses at peaks.

    cells(image_id, ix, iy, logit, pw, ph, pdx, pdy) are the predictions for every cell; heat and peaks are the targets. Cells
    without a target are 0. All three terms are divided by the number of peaks, 1 at least.
    """
    key = ["image_id", "ix", "iy"]
    rows = cells.join(heat, key, "left").join(peaks.withColumn("_peak", F.lit(1)), key, "left")
    is_peak = F.col("_peak").isNotNull()
    focal = _focal(F.col("logit"), F.coalesce("heat", F.lit(0.0)), is_peak)
    off = lambda a, b: F.when(is_peak, F.abs(F.col(a) - F.col(b))).otherwise(0.0)
    sums = rows.agg(
        F.sum(focal).alias("f"), F.sum(off("pw", "w") + off("ph", "h")).alias("s"), F.sum(off("pdx", "dx") + off("pdy", "dy")).alias("o"), F.greatest(F.count_if(is_peak), F.lit(1)).alias("n")
    )
    return _loss(sums, size_weight, offset_weight)


def _focal(logit: Column, y: Column, is_peak: Column) -> Column:
    p = F.least(F.greatest(1 / (1 + F.exp(-logit)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(is_peak, -F.pow(1 - p, F.lit(2.0)) * F.log(p)).otherwise(-F.pow(1 - y, F.lit(4.0)) * F.pow(p, F.lit(2.0)) * F.log(1 - p))


def _loss(sums: DataFrame, size_weight: float, offset_weight: float) -> DataFrame:
    heatmap, wh, offset = F.col("f") / F.col("n"), F.col("s") / F.col("n"), F.col("o") / F.col("n")
    return sums.select((heatmap + size_weight * wh + offset_weight * offset).alias("total"), heatmap.alias("heatmap"), wh.alias("wh"), offset.alias("offset"))


def image_peaks(peaks: DataFrame, order: str) -> DataFrame:
    """(image_id, peaks): the cells of an image that are a peak, with what peak_cells() gives and the greatest radius.

    Of several boxes with their centre in a cell, the one of the greatest radius has the greatest heat everywhere.
    """
    last = [F.max_by(c, order).alias(c) for c in ("w", "h", "dx", "dy")]
    cells = peaks.groupBy("image_id", "ix", "iy").agg(F.max("radius").alias("radius"), *last)
    cells = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")  # not coalesced: rows are small, but become all cells
    return cells.groupBy("image_id").agg(F.collect_list(F.struct("ix", "iy", "radius", "w", "h", "dx", "dy")).alias("peaks"))


def heat_grid(peaks: pa.ListArray, grid: int) -> np.ndarray:
    """The heat of all cells (image, ix, iy) of images whose peaks stand in different cells."""
    owner = np.repeat(np.arange(len(peaks)), peaks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = peaks.flatten()
    ix, iy, radius = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ix", "iy", "radius"))
    out = np.zeros((len(peaks), grid, grid))
    for r in np.unique(radius).tolist():
        at, sigma, reach = np.flatnonzero(radius == r), (2 * r + 1) / 6.0, min(r, grid - 1)
        for dx in range(-reach, reach + 1):
            for dy in range(-reach, reach + 1):  # one offset leads from different peaks to different cells
                x, y = ix[at] + dx, iy[at] + dy
                ok = (x >= 0) & (y >= 0) & (x < grid) & (y < grid)
                cell = owner[at][ok], x[ok], y[ok]
                out[cell] = np.maximum(out[cell], np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))
    return out


def with_heat(images: DataFrame, grid: int) -> DataFrame:
    """images(image_id, peaks) with heat: that of all cells, by ix and then iy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // grid**2)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                heat = heat_grid(b.column("peaks"), grid).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * grid**2), pa.array(heat))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "heat"])

    return images.mapInArrow(run, StructType([*images.schema.fields, StructField("heat", ArrayType(DoubleType(), False))]))


def grid_loss(images: DataFrame, grid: int, predict: Callable[[Column, Column, Column], dict[str, Column]], size_weight: float = 0.1, offset_weight: float = 1.0) -> DataFrame:
    """The result of detection_loss() for every cell of images(image_id, peaks), peaks as image_peaks() has them, null if there are none.

    predict(image_id, ix, iy): logit, pw, ph, pdx and pdy of a cell.
    """
    off = lambda got, p, *pairs: sum((F.abs(got[a] - p[b]) for a, b in pairs), F.lit(0.0))
    total = lambda *pairs: F.aggregate("peaks", F.lit(0.0), lambda s, p: s + off(predict(F.col("image_id"), p["ix"], p["iy"]), p, *pairs))
    rows = with_heat(images.select("image_id", "peaks"), grid)
    rows = rows.select("image_id", total(("pw", "w"), ("ph", "h")).alias("s"), total(("pdx", "dx"), ("pdy", "dy")).alias("o"), "heat")
    rows = rows.select("image_id", "s", "o", F.posexplode("heat").alias("c", "heat"))  # apart from the sums, which are made once an image
    got = predict(F.col("image_id"), F.floor(F.col("c") / grid).cast("int"), (F.col("c") % grid).cast("int"))
    is_peak = F.col("heat") == 1.0  # nowhere else
    once = lambda c: F.coalesce(F.sum(F.when(F.col("c") == 0, F.col(c))), F.lit(0.0)).alias(c)
    sums = rows.agg(F.sum(_focal(got["logit"], F.col("heat"), is_peak)).alias("f"), once("s"), once("o"), F.greatest(F.count_if(is_peak), F.lit(1)).alias("n"))
    return _loss(sums, size_weight, offset_weight)
