"""Random numbers and transforms that any engine repeats: a number is a hash of what it is drawn for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, draw: int) -> Column:
    """A number in [0, 1) from 32 bits of the md5 of ``key:draw``; the same for the same key and draw everywhere."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{draw}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _let(values: dict[str, Column], body) -> Column:
    """body(struct of the values), each computed once a row."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def corner_homography(width: Column, height: Column, moved: list[tuple[Column, Column]]) -> Column:
    """The row-major 3x3 matrix that takes the corners of an image, clockwise from (0, 0), to four points exactly.

    Null where the points do not span a quadrilateral.
    """

    def matrix(c: Column, k: Column) -> Column:
        rows = [
            c["x1"] - c["x0"] + k["g"] * c["x1"], c["x3"] - c["x0"] + k["h"] * c["x3"], c["x0"],
            c["y1"] - c["y0"] + k["g"] * c["y1"], c["y3"] - c["y0"] + k["h"] * c["y3"], c["y0"], k["g"], k["h"],
        ]
        scaled = [v if i in (2, 5) else v / (width if i % 3 == 0 else height) for i, v in enumerate(rows)]
        return F.when(k["g"].isNotNull(), F.array(*scaled, F.lit(1.0)))

    def solved(c: Column) -> Column:
        ax, bx, sx = c["x1"] - c["x2"], c["x3"] - c["x2"], c["x0"] - c["x1"] + c["x2"] - c["x3"]
        ay, by, sy = c["y1"] - c["y2"], c["y3"] - c["y2"], c["y0"] - c["y1"] + c["y2"] - c["y3"]
        size = F.nullif(ax * by - bx * ay, F.lit(0.0))
        return _let({"g": (sx * by - bx * sy) / size, "h": (ax * sy - sx * ay) / size}, lambda k: matrix(c, k))

    return _let({f"{axis}{i}": v for i, p in enumerate(moved) for axis, v in zip("xy", p, strict=True)}, solved)


def random_homography(key: Column, width: Column, height: Column, jitter: float = 0.12) -> Column:
    """A camera move drawn for ``key``: each corner goes up to jitter times the shorter side, either way, along both axes."""
    d = F.least(width, height) * jitter
    corners = [(F.lit(0.0), F.lit(0.0)), (width, F.lit(0.0)), (width, height), (F.lit(0.0), height)]
    off = lambda k: (2 * uniform(key, k) - 1) * d
    moved = [(x + off(2 * k), y + off(2 * k + 1)) for k, (x, y) in enumerate(corners)]
    still = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    return F.coalesce(corner_homography(width, height, moved), still)
