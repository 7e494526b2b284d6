"""Court templates: landmarks in feet, as plain values and as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Half-court dimensions that hold at every level (feet).
CENTER_X, RIM_Y, FREE_THROW_Y, CIRCLE = 25.0, 5.25, 19.0, 6.0
WIDTH, LENGTH = 50.0, 47.0
# Per level, half the lane, the arc radius, and the corner-three spot if the arc has a straight part.
PROFILES = {
    "nba": (8.0, 23.75, (3.0, 14.0)),
    "ncaa": (6.0, 22.146, None),
    "hs": (6.0, 19.75, None),
}
# Order of the half-court landmarks.
HALF_NAMES = [
    "baseline-left-corner",
    "baseline-right-corner",
    "paint-left-baseline",
    "paint-right-baseline",
    "ft-line-left",
    "ft-line-right",
    "ft-line-center",
    "ft-circle-top",
    "three-pt-arc-top",
    "corner-three-left",
    "corner-three-right",
    "rim-center",
    "halfcourt-left-corner",
    "halfcourt-right-corner",
    "halfcourt-center",
    "center-circle-near",
]
# The left half of the full-court schema as index, x, y; baskets stand above the floor.
FULL_LEFT = [
    (0, 0.0, 50.0),
    (1, 0.0, 47.0),
    (2, 0.0, 33.0),
    (3, 0.0, 17.0),
    (4, 0.0, 3.0),
    (5, 0.0, 0.0),
    (6, 5.25, 25.0),
    (7, 14.0, 47.0),
    (8, 14.0, 3.0),
    (9, 19.0, 33.0),
    (10, 19.0, 25.0),
    (11, 19.0, 17.0),
    (12, 28.0, 50.0),
    (13, 29.0, 25.0),
    (14, 28.0, 0.0),
    (15, 47.0, 50.0),
    (16, 47.0, 25.0),
    (17, 47.0, 0.0),
]
# The points of the right half and the left ones they mirror.
FULL_MIRROR = {18: 12, 19: 13, 20: 14, 21: 9, 22: 10, 23: 11, 24: 7, 25: 8, 26: 6, 27: 0, 28: 1, 29: 2, 30: 3, 31: 4, 32: 5}
ELEVATED = (6, 26)
SMOOTHED = (0, 5, 27, 32, 16, 13, 19)


def half_court(profile: str = "nba") -> dict[str, tuple[float, float] | None]:
    """Landmarks of the half court by name; None where the level has no such spot."""
    lane, arc, corner = PROFILES[profile]
    spots: dict[str, tuple[float, float] | None] = {
        "rim-center": (CENTER_X, RIM_Y),
        "ft-line-center": (CENTER_X, FREE_THROW_Y),
        "ft-circle-top": (CENTER_X, FREE_THROW_Y + CIRCLE),
        "three-pt-arc-top": (CENTER_X, RIM_Y + arc),
        "halfcourt-center": (CENTER_X, LENGTH),
        "center-circle-near": (CENTER_X, LENGTH - CIRCLE),
    }
    for side, x in (("left", 0.0), ("right", WIDTH)):
        inward = 1 if side == "left" else -1
        spots[f"baseline-{side}-corner"] = (x, 0.0)
        spots[f"halfcourt-{side}-corner"] = (x, LENGTH)
        spots[f"paint-{side}-baseline"] = (CENTER_X - inward * lane, 0.0)
        spots[f"ft-line-{side}"] = (CENTER_X - inward * lane, FREE_THROW_Y)
        spots[f"corner-three-{side}"] = (x + inward * corner[0], corner[1]) if corner else None
    return {name: spots[name] for name in HALF_NAMES}


def full_court() -> dict[int, tuple[float, float]]:
    """The 33 points of the full court by index."""
    left = {i: (x, y) for i, x, y in FULL_LEFT}
    return left | {i: (94.0 - left[j][0], left[j][1]) for i, j in FULL_MIRROR.items()}


def planar() -> dict[int, tuple[float, float]]:
    return {i: p for i, p in full_court().items() if i not in ELEVATED}


def half_table(spark: SparkSession, profile: str = "nba") -> DataFrame:
    rows = [(i, n, *(p or (None, None))) for i, (n, p) in enumerate(half_court(profile).items())]
    return spark.createDataFrame(rows, "kp int, name string, fx double, fy double")


def full_table(spark: SparkSession) -> DataFrame:
    rows = [(i, x, y, i not in ELEVATED) for i, (x, y) in sorted(full_court().items())]
    return spark.createDataFrame(rows, "kp int, fx double, fy double, planar boolean")


def paint_corners(profile: str = "nba") -> list[tuple[float, float]]:
    spots = half_court(profile)
    return [spots[n] for n in ("paint-left-baseline", "paint-right-baseline", "ft-line-left", "ft-line-right")]


def mirror_index(profile: str = "nba") -> dict[int, int]:
    """For each half-court landmark the one at its mirror image; an error if the court is not symmetric."""
    spots = list(half_court(profile).values())
    out = {}
    for i, p in enumerate(spots):
        if p is None:
            continue
        gaps = [abs(WIDTH - p[0] - q[0]) + abs(p[1] - q[1]) if q else float("inf") for q in spots]
        best = min(range(len(gaps)), key=gaps.__getitem__)
        if gaps[best] > 1e-6:
            raise ValueError(f"landmark {i} has no mirror image")
        out[i] = best
    return out


# A vendor's court dimensions in centimetres.
VENDOR_CM = {"width": 1524, "length": 2865, "paint": 488, "lane": 579, "rim": 160, "arc": 724, "straight": 424, "side": 91, "box": 835}


def vendor_court() -> dict[int, tuple[float, float]]:
    """The vendor's template in feet, y turned over so that it runs like ours; centimetres are halved in whole numbers."""
    v = VENDOR_CM
    low = (v["width"] - v["paint"]) // 2
    mid, high, top = low + v["paint"] // 2, low + v["paint"], v["width"]
    half_y, half_x = v["width"] // 2, v["length"] // 2
    left = [
        (0, 0), (0, v["side"]), (0, low), (0, high), (0, top - v["side"]), (0, top), (v["rim"], half_y),
        (v["straight"], v["side"]), (v["straight"], top - v["side"]), (v["lane"], low), (v["lane"], mid), (v["lane"], high),
        (v["box"], 0), (v["rim"] + v["arc"], half_y), (v["box"], top), (half_x, 0), (half_x, half_y), (half_x, top),
    ]
    cm = dict(enumerate(left)) | {i: (v["length"] - left[j][0], left[j][1]) for i, j in FULL_MIRROR.items()}
    return {i: (x / 30.48, 50.0 - y / 30.48) for i, (x, y) in cm.items()}


def _arc(line: str, cx: float, cy: float, radius: float, start: float, stop: float, n: int, closed: bool = True, side: float = 1.0):
    """(line, i, x, y) of n points on an arc; side -1 turns it over."""
    from pyspark.sql import functions as F

    angle = F.lit(start) + F.col("i") * (stop - start) / (n - 1 if closed else n)
    return F.sequence(F.lit(0), F.lit(n - 1)), lambda: (F.lit(line), F.col("i"), cx + side * radius * F.cos(angle), cy + radius * F.sin(angle))


def _table(spark: SparkSession, straight: list[tuple[str, list[tuple[float, float]]]], arcs: list) -> DataFrame:
    from pyspark.sql import functions as F

    rows = [(name, i, float(x), float(y)) for name, points in straight for i, (x, y) in enumerate(points)]
    out = spark.createDataFrame(rows, "line string, i int, x double, y double")
    for steps, cols in arcs:
        line, i, x, y = cols()
        out = out.unionByName(spark.range(1).select(F.explode(steps).alias("i")).select(line.alias("line"), i.cast("int").alias("i"), x.alias("x"), y.alias("y")))
    return out


def full_lines(spark: SparkSession) -> DataFrame:
    """(line, i, x, y): the lines of the full court as points in order; round ones in sixty steps."""
    from math import pi

    turn, arc, (inset, reach) = 2 * pi, PROFILES["nba"][1], PROFILES["nba"][2]
    far, lane = 2 * LENGTH, PROFILES["nba"][0]
    straight = [("outer", [(0, 0), (far, 0), (far, WIDTH), (0, WIDTH), (0, 0)]), ("half", [(LENGTH, 0), (LENGTH, WIDTH)])]
    arcs = [_arc("center-circle", LENGTH, CENTER_X, CIRCLE, 0.0, turn, 60)]
    for name, x, s in (("left", 0.0, 1.0), ("right", far, -1.0)):
        line = x + s * FREE_THROW_Y
        straight.append((f"{name}-paint", [(x, CENTER_X - lane), (line, CENTER_X - lane), (line, CENTER_X + lane), (x, CENTER_X + lane)]))
        straight += [(f"{name}-corner-{k}", [(x, y), (x + s * reach, y)]) for k, y in (("low", inset), ("high", WIDTH - inset))]
        arcs += [_arc(f"{name}-circle", line, CENTER_X, CIRCLE, 0.0, turn, 60), _arc(f"{name}-arc", x + s * RIM_Y, CENTER_X, arc, -1.2, 1.2, 60, side=s)]
    return _table(spark, straight, arcs)


CURVES = {"three", "center", "halfcourt", "ft-circle"}


def half_curves(spark: SparkSession, names: list[str], profile: str = "nba") -> DataFrame:
    """(line, i, x, y): the asked curves of the half court as points in order; an unknown name is an error."""
    from math import pi

    if unknown := sorted(set(names) - CURVES):
        raise ValueError(f"unknown curves: {', '.join(unknown)}")
    arcs = {
        "three": _arc("three", CENTER_X, RIM_Y, PROFILES[profile][1], 0.39, pi - 0.39, 80),
        "center": _arc("center", CENTER_X, LENGTH, CIRCLE, pi, 2 * pi, 40),
        "ft-circle": _arc("ft-circle", CENTER_X, FREE_THROW_Y, CIRCLE, 0.0, 2 * pi, 40, closed=False),
    }
    straight = [("halfcourt", [(0.5 + k, LENGTH) for k in range(50)])] if "halfcourt" in names else []
    return _table(spark, straight, [arcs[n] for n in names if n in arcs]).filter(f"y <= {LENGTH} + 1e-9")
