"""Boxes, plane projections and court regions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feet per second to miles per hour.
MPH = 0.681818
HALF_WIDTH, HALF_LENGTH = 50.0, 47.0
FULL_LENGTH, FULL_WIDTH = 94.0, 50.0


def box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def center(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def foot(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, b["y2"])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if either is empty."""
    small = F.least(area(a), area(b))
    return F.when((small > 0) & (overlap(a, b) > 0), overlap(a, b) / small).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return both / (area(a) + area(b) - both + 1e-9)


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def project(h: Column, x: Column, y: Column) -> Column:
    """A point through a row-major 3x3 homography; null where it lies at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    fine = F.abs(w) > 1e-12
    return point(
        F.when(fine, (h[0] * x + h[1] * y + h[2]) / w), F.when(fine, (h[3] * x + h[4] * y + h[5]) / w)
    )


def inverse(h: Column) -> Column:
    """The inverse of a 3x3 matrix by its adjugate; null if singular."""
    a, b, c, d, e, f, g, i, j = (h[k] for k in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return F.when(F.abs(det) > 1e-300, F.array(*[x / det for x in adj]))


def in_half_court(x: Column, y: Column, margin: float = 3.0) -> Column:
    return x.between(-margin, HALF_WIDTH + margin) & y.between(-margin, HALF_LENGTH + margin)


def in_full_court(x: Column, y: Column, margin: float = 2.0) -> Column:
    return x.between(-margin, FULL_LENGTH + margin) & y.between(-margin, FULL_WIDTH + margin)


def promote(affine: Column) -> Column:
    """A row-major 2x3 affine matrix as 3x3."""
    return F.concat(affine, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def warp_box(b: Column, affine: Column) -> Column:
    """The centre moved by a 2x3 affine matrix, the size scaled by the root of its area factor."""
    c = center(b)
    x = affine[0] * c["x"] + affine[1] * c["y"] + affine[2]
    y = affine[3] * c["x"] + affine[4] * c["y"] + affine[5]
    s = F.sqrt(F.abs(affine[0] * affine[4] - affine[1] * affine[3]))
    w, h = (b["x2"] - b["x1"]) * s / 2, (b["y2"] - b["y1"]) * s / 2
    return box(x - w, y - h, x + w, y + h)


def torso(b: Column, width: Column, height: Column) -> Column:
    """The torso part of a player box in whole pixels, null if under two pixels a side."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    cut = lambda v, top: F.greatest(F.lit(0), F.least(v.cast("int"), top.cast("int")))
    t = box(cut(b["x1"] + 0.2 * w, width), cut(b["y1"] + 0.2 * h, height), cut(b["x1"] + 0.8 * w, width), cut(b["y1"] + 0.55 * h, height))
    return F.when((t["x2"] - t["x1"] >= 2) & (t["y2"] - t["y1"] >= 2), t)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def rescale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def seconds(frame: Column, fps: Column) -> Column:
    return frame / fps


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or one has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
