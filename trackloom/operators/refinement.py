"""Refinement of court homographies against line pixels: robust non-linear least squares over all frames at once.

A frame's unknowns are the eight free entries of the map from feet to pixels. In a round every model point is projected, the
darkest line pixel along its curve's normal is its target, and a few Gauss-Newton steps with Huber weights
move the unknowns. refine() makes all rounds of a frame on one row, in numpy; matched(), anchors(), normal_equations()
and solved() are the same steps as joins and sums over tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registration import curve_normals

KEY = ["clip_id", "frame"]
UPPER = [(i, j) for i in range(8) for j in range(i, 8)]


@dataclass(frozen=True)
class RefineRule:
    """rounds of matching, steps in each; search: pixels along the normal; dark: greatest gray value of a line pixel;
    huber: pixels beyond which a residual counts linearly; anchor: weight of corner residuals; least: matches that a frame needs."""

    rounds: int = 5
    steps: int = 2
    search: int = 12
    dark: int = 128
    huber: float = 3.0
    anchor: float = 12.0
    least: int = 8


def _seen(p: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    w = p[6] * x + p[7] * y + 1.0
    return (p[0] * x + p[1] * y + p[2]) / w, (p[3] * x + p[4] * y + p[5]) / w, w


def matched(points: DataFrame, pixels: DataFrame, params: DataFrame, rule: RefineRule) -> DataFrame:
    """(clip_id, frame, fx, fy, tx, ty, nx, ny, weight): model points with the line pixel found along their normal.

    points(clip_id, frame, curve, i, fx, fy), pixels(clip_id, frame, px, py, gray), params(clip_id, frame, p). A sample's pixel
    is looked up by an equi-join on its cell, so only pixels that some sample hits are ever paired. Of equally dark ones the
    sample nearest the point, then the one before it, is taken.
    """
    # points, samples and targets are many to a frame, which sizes guessed from the files do not tell: none is broadcast
    rows = points.hint("merge").join(params, KEY)
    x, y, _ = _seen(F.col("p"), F.col("fx"), F.col("fy"))
    rows = curve_normals(rows.withColumns({"x": x, "y": y}), [*KEY, "curve"])
    t = F.explode(F.sequence(F.lit(-rule.search), F.lit(rule.search))).alias("t")
    samples = rows.where((F.col("nx") != 0) | (F.col("ny") != 0)).select(*KEY, "curve", "i", "fx", "fy", "x", "y", "nx", "ny", t)
    sx, sy = F.col("x") + F.col("t") * F.col("nx"), F.col("y") + F.col("t") * F.col("ny")
    samples = samples.withColumns({"sx": sx, "sy": sy}).withColumns({"px": F.rint("sx").cast("int"), "py": F.rint("sy").cast("int")})
    hit = samples.hint("merge").join(pixels.where(F.col("gray") <= rule.dark), [*KEY, "px", "py"])
    best = hit.groupBy(*KEY, "curve", "i").agg(F.min(F.struct("gray", F.abs("t").alias("far"), "t", "sx", "sy", "fx", "fy", "nx", "ny")).alias("b"))
    return best.select(*KEY, "b.fx", "b.fy", F.col("b.sx").alias("tx"), F.col("b.sy").alias("ty"), "b.nx", "b.ny", F.lit(1.0).alias("weight"))


def anchors(corners: DataFrame, rule: RefineRule) -> DataFrame:
    """Corner residuals in the form of matched(): one along each axis. corners(clip_id, frame, fx, fy, tx, ty)."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("nx"), F.lit(1.0 - a).alias("ny")) for a in (1.0, 0.0)])).alias("a")
    return corners.select(*KEY, "fx", "fy", "tx", "ty", axes).select(*KEY, "fx", "fy", "tx", "ty", "a.nx", "a.ny", F.lit(rule.anchor).alias("weight"))


def normal_equations(targets: DataFrame, params: DataFrame, rule: RefineRule) -> DataFrame:
    """(clip_id, frame, p, n, a, b): the upper triangle of the 8 x 8 matrix, row by row, and the right-hand side of one step."""
    rows = targets.hint("merge").join(params, KEY)
    u, v, w = _seen(F.col("p"), F.col("fx"), F.col("fy"))
    rows = rows.withColumns({"u": u, "v": v, "w": w})
    c = F.col
    r = ((c("u") - c("tx")) * c("nx") + (c("v") - c("ty")) * c("ny")) * c("weight")
    along = c("u") * c("nx") + c("v") * c("ny")
    slopes = [c("nx") * c("fx"), c("nx") * c("fy"), c("nx"), c("ny") * c("fx"), c("ny") * c("fy"), c("ny"), -along * c("fx"), -along * c("fy")]
    rows = rows.select(*KEY, "p", "weight", r.alias("r"), *[(s / c("w") * c("weight")).alias(f"j{k}") for k, s in enumerate(slopes)])
    rows = rows.withColumn("h", F.when(F.abs("r") > rule.huber, rule.huber / F.abs("r")).otherwise(1.0))
    a = [F.sum(c("h") * c(f"j{i}") * c(f"j{j}")).alias(f"a{i}{j}") for i, j in UPPER]
    b = [F.sum(c("h") * c(f"j{i}") * c("r")).alias(f"b{i}") for i in range(8)]
    out = rows.groupBy(*KEY).agg(F.first("p").alias("p"), F.count_if(c("weight") == 1.0).alias("n"), *a, *b)
    return out.select(*KEY, "p", "n", F.array(*[f"a{i}{j}" for i, j in UPPER]).alias("a"), F.array(*[f"b{i}" for i in range(8)]).alias("b"))


def _moved(p: np.ndarray, n: int, m: np.ndarray, b: np.ndarray, rule: RefineRule) -> np.ndarray:
    scale = np.sqrt(np.diag(m))
    if n >= rule.least and np.isfinite(m).all() and (scale > 0).all():
        # entries differ by many orders of magnitude, so each is scaled by its own
        step = np.linalg.lstsq(m / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
        return p - step if np.isfinite(step).all() else p
    return p


def solved(equations: DataFrame, rule: RefineRule) -> DataFrame:
    """(clip_id, frame, p) one step further; a frame with too few matches or a singular matrix stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cols = np.array(UPPER).T
        for pdf in batches:
            out = []
            for p, n, a, b in zip(pdf["p"], pdf["n"], pdf["a"], pdf["b"], strict=True):
                m = np.zeros((8, 8))
                m[rows, cols] = m[cols, rows] = a
                out.append(_moved(np.asarray(p, float), n, m, np.asarray(b, float), rule))
            yield pdf[KEY].assign(p=out)

    kinds = ", ".join(f"{k} {equations.schema[k].dataType.simpleString()}" for k in KEY)
    return equations.select(*KEY, "p", "n", "a", "b").mapInPandas(run, f"{kinds}, p array<double>")


def _sight(p: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = p[6] * fx + p[7] * fy + 1.0
    return (p[0] * fx + p[1] * fy + p[2]) / w, (p[3] * fx + p[4] * fy + p[5]) / w, w


def _normals(curve: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """curve_normals() of points in order of curve and place."""
    new = np.concatenate([[True], curve[1:] != curve[:-1]])

    def slope(c: np.ndarray) -> np.ndarray:
        back = np.where(new, np.nan, np.concatenate([[np.nan], c[:-1]]))
        ahead = np.where(np.concatenate([new[1:], [True]]), np.nan, np.concatenate([c[1:], [np.nan]]))
        alone = np.isnan(back) & np.isnan(ahead)
        return np.where(alone, 0.0, np.where(np.isnan(back), ahead - c, np.where(np.isnan(ahead), c - back, (ahead - back) / 2)))

    tx, ty = slope(x), slope(y)
    size = np.sqrt(tx * tx + ty * ty)
    size = np.where(size > 0, size, 1.0)
    return -ty / size, tx / size


def _found(points: tuple, keys: np.ndarray, gray: np.ndarray, p: np.ndarray, rule: RefineRule) -> np.ndarray:
    """matched() of one frame: columns fx, fy, tx, ty, nx, ny, weight. keys: px << 32 | py of its pixels, ascending, each once."""
    curve, fx, fy = points
    if not len(fx) or not len(keys):
        return np.empty((0, 7))
    x, y, _ = _sight(p, fx, fy)
    nx, ny = _normals(curve, x, y)
    t = np.array(sorted(range(-rule.search, rule.search + 1), key=lambda k: (abs(k), k)))  # the nearest first
    sx, sy = x[:, None] + t * nx[:, None], y[:, None] + t * ny[:, None]
    fine = (np.abs(sx) < 1 << 31) & (np.abs(sy) < 1 << 31) & ((nx != 0) | (ny != 0))[:, None]
    key = np.where(fine, np.rint(sx), 0).astype(np.int64) << 32 | np.where(fine, np.rint(sy), 0).astype(np.int64) & 0xFFFFFFFF
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    dark = np.where(fine & (keys[at] == key), gray[at], np.inf)
    best = dark.argmin(1)  # the first of equals
    rows = np.flatnonzero(np.isfinite(dark.min(1)))
    best = best[rows]
    return np.column_stack([fx[rows], fy[rows], sx[rows, best], sy[rows, best], nx[rows], ny[rows], np.ones(len(rows))])


def _step(targets: np.ndarray, p: np.ndarray, rule: RefineRule) -> np.ndarray:
    """normal_equations() and solved() of one frame."""
    fx, fy, tx, ty, nx, ny, weight = targets.T
    u, v, w = _sight(p, fx, fy)
    r = ((u - tx) * nx + (v - ty) * ny) * weight
    along = u * nx + v * ny
    j = np.column_stack([nx * fx, nx * fy, nx, ny * fx, ny * fy, ny, -along * fx, -along * fy]) / w[:, None] * weight[:, None]
    h = np.where(np.abs(r) > rule.huber, rule.huber / np.maximum(np.abs(r), rule.huber), 1.0)
    return _moved(p, int((weight == 1.0).sum()), (j * h[:, None]).T @ j, (j * h[:, None]).T @ r, rule)


def refine(points: DataFrame, pixels: DataFrame, corners: DataFrame, initial: DataFrame, rule: RefineRule = RefineRule()) -> DataFrame:
    """(clip_id, frame, p) after all rounds, for the frames of initial(clip_id, frame, p).

    A frame's points, dark pixels and corners are gathered once, into a row; all rounds are made on that row, so that no
    sample or target leaves its task. A frame without any line pixel or corner keeps its initial values.
    """

    def gathered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        one = F.collect_list(F.struct(*columns))
        return df.groupBy(*KEY).agg((F.sort_array(one) if name == "points" else one).alias(name)).hint("merge")

    rows = initial.select(*KEY, F.col("p").cast("array<double>").alias("p")).hint("merge")
    rows = rows.join(gathered(points, "points", "curve", "i", "fx", "fy"), KEY, "left")
    rows = rows.join(gathered(pixels.where(F.col("gray") <= rule.dark), "pixels", "px", "py", "gray"), KEY, "left")
    rows = rows.join(gathered(corners.dropna(subset=["fx", "fy", "tx", "ty"]), "corners", "fx", "fy", "tx", "ty"), KEY, "left")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                part = {c: b.column(c)[k].values for c in ("points", "pixels", "corners")}
                number = lambda t, c: np.asarray(part[t].field(c).cast(pa.float64()).fill_null(np.nan)) if part[t] is not None else np.empty(0)
                curve = np.asarray(part["points"].field("curve").dictionary_encode().indices) if part["points"] is not None else np.empty(0, int)
                at = number("pixels", "px").astype(np.int64) << 32 | number("pixels", "py").astype(np.int64) & 0xFFFFFFFF
                gray = number("pixels", "gray")
                order = np.lexsort((gray, at))
                keys, first = np.unique(at[order], return_index=True)
                gray = gray[order][first]
                seen = (curve, number("points", "fx"), number("points", "fy"))
                c = np.column_stack([number("corners", x) for x in ("fx", "fy", "tx", "ty")])
                fixed = np.concatenate([np.column_stack([c, np.full(len(c), a), np.full(len(c), 1.0 - a), np.full(len(c), rule.anchor)]) for a in (1.0, 0.0)])
                p = np.array(b.column("p")[k].as_py(), float)
                with np.errstate(all="ignore"):
                    for _ in range(rule.rounds):
                        targets = np.concatenate([_found(seen, keys, gray, p, rule), fixed])
                        for _ in range(rule.steps if len(targets) else 0):
                            p = _step(targets, p, rule)
                out.append(p.tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(out, pa.list_(pa.float64()))], names=[*KEY, "p"])

    return rows.mapInArrow(run, f"{kinds}, p array<double>")
