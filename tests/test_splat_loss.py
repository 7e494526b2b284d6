"""The loss of a detector's targets without a table of all cells."""

from __future__ import annotations

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from trackloom.operators import splat


def predict(image, ix, iy):
    logit = ((image + 7 * ix + 13 * iy) % 17 - 12) / F.lit(3.0)
    return {"logit": logit, "pw": (ix % 5).cast("double"), "ph": (iy % 7).cast("double"), "pdx": (ix % 3) / F.lit(3.0), "pdy": (iy % 3) / F.lit(3.0)}


def test_as_the_join_of_all_cells(spark):
    """Shared cells, borders, large and small boxes, an image without boxes and one without an id."""
    grid, key = 12, ["image_id", "ix", "iy"]
    boxes = [(i % 3, i, (i * 7 % 13) / 13, (i * 5 % 11) / 11, 0.05 + (i % 9) / 9, 0.08 + (i % 7) / 7) for i in range(60)]
    boxes += [(0, 100, 0.5, 0.5, 0.9, 0.9), (0, 101, 0.5, 0.5, 0.1, 0.1), (1, 102, 1.0, 1.0, 0.3, 0.3), (None, 103, 0.4, 0.4, 0.3, 0.3)]
    peaks = splat.targets(spark.createDataFrame(boxes, "image_id long, ord int, cx double, cy double, w double, h double"), grid)
    images = spark.createDataFrame([(0,), (1,), (2,), (7,), (None,)], "image_id long")
    cells = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(grid**2 - 1))).alias("c"))
    cells = cells.select("image_id", F.floor(F.col("c") / grid).cast("int").alias("ix"), (F.col("c") % grid).cast("int").alias("iy"))
    want = splat.detection_loss(cells.withColumns(predict(*map(F.col, key))), splat.heat_cells(peaks, grid), splat.peak_cells(peaks, "ord")).first()
    got = splat.grid_loss(images.join(splat.image_peaks(peaks, "ord"), "image_id", "left"), grid, predict).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-12)


def test_no_cells_are_shuffled(spark):
    df = __spark_entry__.queries()["detection_loss"](spark, __spark_entry__.SMOKE)
    above, below = df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode(heat", 1)
    assert "Join" not in above and "explode" not in below
    assert "aggregate(peaks" not in above and "aggregate(peaks" in below  # once an image, not once a cell
