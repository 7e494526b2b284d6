"""Homographies from court keypoints, their smoothing over time, and their errors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import courts
from ..functions import geometry as g


def _normaliser(p: np.ndarray) -> np.ndarray:
    mid = p.mean(0)
    spread = np.sqrt(((p - mid) ** 2).sum(1)).mean()
    s = np.sqrt(2) / spread if spread > 0 else 1.0
    return np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares homography by the normalised direct linear transform; None if the points do not determine one."""
    if len(src) < 4:
        return None
    a, b = _normaliser(src), _normaliser(dst)
    p = np.c_[src, np.ones(len(src))] @ a.T
    q = np.c_[dst, np.ones(len(dst))] @ b.T
    zero = np.zeros_like(p)
    rows = np.concatenate((np.hstack((p, zero, -q[:, :1] * p)), np.hstack((zero, p, -q[:, 1:2] * p))))
    _, s, vt = np.linalg.svd(rows)
    if s[min(7, len(s) - 1)] < 1e-10 * s[0]:
        return None
    h = np.linalg.inv(b) @ vt[-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply_homography(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def robust_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 8.0, tries: int = 200, least: int = 4, seed: int = 0):
    """(homography, inlier mask) by random samples of four, or None. The threshold is in units of dst."""
    if len(src) < 4:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    near = lambda h: np.nan_to_num(np.sqrt(((apply_homography(h, src) - dst) ** 2).sum(1)), nan=np.inf) <= threshold
    whole = solve_homography(src, dst)
    if whole is not None:
        best = near(whole)
    for _ in range(0 if best.all() else tries):
        k = rng.choice(len(src), 4, replace=False)
        h = solve_homography(src[k], dst[k])
        if h is not None and (mask := near(h)).sum() > best.sum():
            best = mask
    if best.sum() < least:
        return None
    h = solve_homography(src[best], dst[best])
    return None if h is None else (h, best)


def best_instance(keypoints: DataFrame, key: list[str]) -> DataFrame:
    """Of the court instances seen in a frame the one with the greatest summed confidence; keypoints(…, instance, kp, x, y, conf)."""
    total = keypoints.groupBy(*key, "instance").agg(F.sum("conf").alias("s"))
    best = total.groupBy(*key).agg(F.min(F.struct((-F.col("s")).alias("o"), "instance")).alias("b")).select(*key, F.col("b.instance").alias("instance"))
    return keypoints.join(best, [*key, "instance"], "left_semi")


def usable_keypoints(keypoints: DataFrame, least_conf: float, least: int, key: list[str]) -> DataFrame:
    """Confident points on the floor, of frames that have enough of them."""
    w = Window.partitionBy(*key)
    kept = keypoints.filter((F.col("conf") >= least_conf) & ~F.col("kp").isin(*courts.ELEVATED))
    return kept.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= least).drop("_n")


FIT = "clip_id string, frame long, h array<double>, inliers array<int>"


def fit_frames(keypoints: DataFrame, threshold: float = 8.0, least: int = 4) -> DataFrame:
    """(clip_id, frame, h, inliers) of frames with enough planar points; frames are independent of each other."""
    template = courts.planar()
    floor = keypoints.filter(~F.col("kp").isin(*courts.ELEVATED))
    rows = floor.groupBy(F.col("clip_id").cast("string").alias("clip_id"), F.col("frame").cast("long").alias("frame")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("kp").cast("int").alias("kp"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("pts")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for clip, frame, pts in zip(pdf["clip_id"], pdf["frame"], pdf["pts"], strict=True):
                idx = np.array([p["kp"] for p in pts])
                src, dst = np.array([[p["x"], p["y"]] for p in pts]), np.array([template[i] for i in idx])
                got = robust_homography(src, dst, threshold, least=least) if len(idx) >= least else None
                if got is not None:
                    out.append((clip, frame, got[0].ravel(), idx[got[1]].astype(np.int32)))
            yield pd.DataFrame(out, columns=["clip_id", "frame", "h", "inliers"])

    return rows.mapInPandas(run, FIT)


@dataclass(frozen=True)
class RegistrarRule:
    alpha: float = 0.35
    max_misses: int = 15
    threshold: float = 8.0
    least: int = 4


def _averaged(w: Window, alpha: float, v: str, add) -> Column:
    """Exponential average of the rows of a window: the weight of older ones falls under what a double can hold."""
    back = int(np.ceil(-38 / np.log(1 - alpha))) if alpha < 1 else 1
    rows = F.collect_list(v).over(w.rowsBetween(-back, 0))
    return F.aggregate(F.slice(rows, 2, back), rows[0], lambda e, x: add(e, x, alpha))


def smoothed_anchors(fits: DataFrame, rule: RegistrarRule = RegistrarRule()) -> DataFrame:
    """fits(clip_id, frame, h) with good (a frame with a fit), last (misses since one), run and the averaged anchors.

    The anchors are a few floor points seen through the inverse fit; they are averaged over the good frames of a
    run, and a run ends where more than max_misses frames in a row have no fit. Windows over a clip's frames do all
    of it: no state is carried by hand.
    """
    full = courts.full_court()
    order = Window.partitionBy("clip_id").orderBy("frame")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    f = fits.withColumns({"good": F.col("h").isNotNull(), "n": F.row_number().over(order)})
    at = F.when(F.col("good"), F.col("n"))
    f = f.withColumn("last", F.col("n") - F.max(at).over(so_far))
    gap = F.col("n") - F.max(at).over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1
    f = f.withColumn("_new", F.when(F.col("good") & F.coalesce(gap > rule.max_misses, F.lit(True)), 1).otherwise(0))
    f = f.withColumn("run", F.sum("_new").over(so_far))
    # one lambda for all points, with the inverse as a value: written out for each it would be a huge expression
    feet = F.array(*[g.point(F.lit(full[i][0]), F.lit(full[i][1])) for i in courts.SMOOTHED])
    pair = lambda p: F.array(p["x"], p["y"])
    seen = lambda back: F.flatten(F.transform(feet, lambda p: pair(g.project(back, p["x"], p["y"]))))
    f = f.withColumn("_seen", F.when(F.col("good"), F.transform(F.array(g.inverse(F.col("h"))), seen)[0]))
    within = Window.partitionBy("clip_id", "run", "good").orderBy("frame")
    mean = _averaged(within, rule.alpha, "_seen", lambda e, x, al: F.zip_with(e, x, lambda p, q: (1 - al) * p + al * q))
    return f.withColumn("anchors", F.when(F.col("good"), mean)).drop("_new", "_seen", "n")


def registered(keypoints: DataFrame, frames: DataFrame, rule: RegistrarRule = RegistrarRule()) -> DataFrame:
    """(clip_id, frame, h) for every row of frames(clip_id, frame); h is null where registration is unavailable.

    A frame with a fit has the homography of its averaged anchors, or its own if they determine none; one without
    keeps the last for up to max_misses frames. Both kinds of fit are made for all frames in parallel.
    """
    base = frames.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("frame").cast("long").alias("frame"))
    fits = base.join(fit_frames(keypoints, rule.threshold, rule.least).select("clip_id", "frame", "h"), ["clip_id", "frame"], "left")
    full = courts.full_court()
    feet = np.array([full[i] for i in courts.SMOOTHED])

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, anchors in zip(pdf["h"], pdf["anchors"], strict=True):
                h = None if anchors is None else solve_homography(np.asarray(anchors, float).reshape(-1, 2), feet)
                out.append(own if h is None else h.ravel())
            yield pdf[["clip_id", "frame", "last"]].assign(h=out)

    done = smoothed_anchors(fits, rule).select("clip_id", "frame", "last", "h", "anchors").mapInPandas(refit, "clip_id string, frame long, last int, h array<double>")
    so_far = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("last") <= rule.max_misses, F.last("h", ignorenulls=True).over(so_far))
    return done.select("clip_id", "frame", held.alias("h"))


def registration_rate(found: DataFrame, least: float = 0.8, key: str = "clip_id") -> DataFrame:
    """Share of registered frames and whether court analytics may be had from them."""
    out = found.groupBy(key).agg(F.avg(F.col("h").isNotNull().cast("int")).alias("rate"))
    return out.withColumn("court_analytics", F.when(F.col("rate") >= least, "ok").otherwise("unavailable"))


def accumulated_motion(motions: DataFrame, key: str = "clip_id") -> DataFrame:
    """(clip, frame, h): products of the frame-to-frame matrices; null or missing motion is the identity.

    motions(clip, frame, affine: row-major 2x3). The product is a fold along a clip, one step a frame.
    """
    one = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    kind = motions.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("frame", kind="stable"), np.eye(3), []
        for m in pdf["m"]:
            now = now @ np.asarray(m, float).reshape(3, 3)
            out.append(now.ravel())
        return pdf[[key, "frame"]].assign(h=out)

    m = motions.select(key, F.col("frame").cast("long").alias("frame"), F.coalesce(g.promote(F.col("affine")), one).alias("m"))
    return m.groupBy(key).applyInPandas(fold, f"{key} {kind}, frame long, h array<double>")


def ema(values: DataFrame, alpha: float, key: str = "clip_id") -> DataFrame:
    """values(clip, frame, v) with the exponential average e; a null v keeps the last one."""
    known = F.col("v").isNotNull()
    v = values.select(key, F.col("frame").cast("long").alias("frame"), F.col("v").cast("double").alias("v"), known.alias("_k"))
    mean = _averaged(Window.partitionBy(key, "_k").orderBy("frame"), alpha, "v", lambda e, x, al: (1 - al) * e + al * x)
    so_far = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("_e", F.when(F.col("_k"), mean)).select(key, "frame", F.last("_e", ignorenulls=True).over(so_far).alias("e"))


def curve_normals(points: DataFrame, key: list[str], order: str = "i") -> DataFrame:
    """points(…, i, x, y) with the unit normal (nx, ny) of the curve: across half the way from the point before to the
    next, at the ends from or to the point itself; (0, 0) where the curve stands still."""
    w = Window.partitionBy(*key).orderBy(order)

    def slope(c: str) -> Column:
        back, ahead, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        return F.when(back.isNull() & ahead.isNull(), 0.0).when(back.isNull(), ahead - here).when(ahead.isNull(), here - back).otherwise((ahead - back) / 2)

    out = points.withColumns({"_tx": slope("x"), "_ty": slope("y")})
    size = F.sqrt(F.col("_tx") * F.col("_tx") + F.col("_ty") * F.col("_ty"))
    size = F.when(size > 0, size).otherwise(1.0)
    return out.withColumns({"nx": -F.col("_ty") / size, "ny": F.col("_tx") / size}).drop("_tx", "_ty")


def reprojection(points: DataFrame, h: Column) -> DataFrame:
    """points(…, kp, x, y, fx, fy) with err: feet between the projected point and where it should be."""
    p = g.project(h, F.col("x"), F.col("y"))
    return points.withColumn("err", g.distance(p["x"], p["y"], F.col("fx"), F.col("fy")))


def error_summary(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    agg = [F.avg("err").alias("mean_err"), F.median("err").alias("median_err"), F.percentile("err", F.lit(0.9)).alias("p90_err"), F.percentile("err", F.lit(0.99)).alias("p99_err"), F.count(F.lit(1)).alias("n")]
    return errors.groupBy(*by).agg(*agg) if by else errors.agg(*agg)


def projected_keypoints(frames: DataFrame, template: DataFrame, h: Column) -> DataFrame:
    """frames(…, width, height) × template(kp, fx, fy), seen through the inverse of h: (x, y, v).

    v is 2 inside the frame; landmarks that are missing or outside have (0, 0, 0). The template is a few dozen rows.
    """
    p = g.project(g.inverse(h), F.col("fx"), F.col("fy"))
    out = frames.crossJoin(F.broadcast(template)).withColumn("_p", p)
    seen = F.coalesce((F.col("_p.x") >= 0) & (F.col("_p.x") < F.col("width")) & (F.col("_p.y") >= 0) & (F.col("_p.y") < F.col("height")), F.lit(False))
    return out.withColumns({"x": F.when(seen, F.col("_p.x")).otherwise(0.0), "y": F.when(seen, F.col("_p.y")).otherwise(0.0), "v": F.when(seen, 2).otherwise(0)}).drop("_p")


def warped_keypoints(kps: DataFrame, h: Column) -> DataFrame:
    """kps(…, x, y, v, width, height) moved by h; what is absent or leaves the frame is absent."""
    p = g.project(h, F.col("x"), F.col("y"))
    seen = F.coalesce((F.col("v") > 0) & (p["x"] >= 0) & (p["x"] < F.col("width")) & (p["y"] >= 0) & (p["y"] < F.col("height")), F.lit(False))
    return kps.withColumns({"x": F.when(seen, p["x"]).otherwise(0.0), "y": F.when(seen, p["y"]).otherwise(0.0), "v": F.when(seen, F.col("v")).otherwise(0)})


def flipped_keypoints(kps: DataFrame, profile: str = "nba") -> DataFrame:
    """kps(…, kp, x, y, v, width) in the mirror: x turned over, every landmark renamed as its mirror image."""
    pairs = F.create_map(*[F.lit(x) for i, j in courts.mirror_index(profile).items() for x in (i, j)])
    seen = F.col("v") > 0
    return kps.withColumns({"x": F.when(seen, F.col("width") - 1 - F.col("x")).otherwise(F.col("x")), "kp": pairs[F.col("kp")].cast("int")})


def keypoint_boxes(kps: DataFrame, key: list[str]) -> DataFrame:
    """The box (x, y, w, h) around visible points, zeros without any."""
    v = lambda f, c: F.coalesce(f(F.when(F.col("v") > 0, F.col(c))), F.lit(0.0))
    out = kps.groupBy(*key).agg(v(F.min, "x").alias("x"), v(F.min, "y").alias("y"), v(F.max, "x").alias("x2"), v(F.max, "y").alias("y2"), F.count_if(F.col("v") > 0).alias("n_visible"))
    return out.select(*key, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "n_visible")


def template_gaps(spark) -> DataFrame:
    """(kp, gap_ft) between our full court and the vendor's."""
    ours, theirs = courts.full_court(), courts.vendor_court()
    df = spark.createDataFrame([(i, *ours[i], *theirs[i]) for i in sorted(ours)], "kp int, ax double, ay double, bx double, by_ double")
    return df.select("kp", g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")).alias("gap_ft"))


def ordered_corners(quads: DataFrame, flip: bool = False) -> DataFrame:
    """quads(id, points: array of four {x, y}, basket {x, y}) as (baseline left, right, free-throw left, right).

    Corners in order of their angle about the middle; the baseline is the side whose ends are together nearest to
    the basket; left and right follow image x, swapped by flip.
    """
    mid = lambda c: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c]) / 4
    q = quads.withColumn("_m", g.point(mid("x"), mid("y")))
    turned = F.array_sort(F.transform("points", lambda p: F.struct(F.atan2(p["y"] - F.col("_m.y"), p["x"] - F.col("_m.x")).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    q = q.withColumn("_q", turned)
    d = lambda k: g.distance(F.col("_q")[k % 4]["x"], F.col("_q")[k % 4]["y"], F.col("basket.x"), F.col("basket.y"))
    side = F.array_min(F.array(*[F.struct((d(k) + d(k + 1)).alias("d"), F.lit(k).alias("k")) for k in range(4)]))["k"]
    q = q.withColumn("_k", side)
    at = lambda n: F.get("_q", F.pmod(F.col("_k") + n, F.lit(4)))
    q = q.withColumns({"_bl": at(0), "_br": at(1), "_fr": at(2), "_fl": at(3)})
    swap = (F.col("_bl.x") > F.col("_br.x")) != F.lit(flip)
    two = lambda a, b, n: F.when(swap, F.struct(F.col(f"{b}.x").alias("x"), F.col(f"{b}.y").alias("y"))).otherwise(F.struct(F.col(f"{a}.x").alias("x"), F.col(f"{a}.y").alias("y"))).alias(n)
    return q.select("id", two("_bl", "_br", "baseline_left"), two("_br", "_bl", "baseline_right"), two("_fl", "_fr", "ft_left"), two("_fr", "_fl", "ft_right"))


def recovered_template(observations: DataFrame, reference: dict[int, tuple[float, float]], passes: int = 4, least: int = 4, threshold: float = 5.0) -> dict[int, tuple[float, float]]:
    """All landmarks in the reference frame, by chaining homographies: observations(image_id, kp, x, y).

    Each pass fits every image to the landmarks known so far, in parallel, and takes the median of every
    landmark over all projections of this and the earlier passes. The template is a few dozen points.
    """
    rows = observations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("kp", "x", "y"))).alias("pts"))
    spark, template = observations.sparkSession, dict(reference)
    every = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in reference.items()], "kp int, x double, y double")

    for _ in range(passes):
        now = dict(template)

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for pts in pdf["pts"]:
                    known = [p for p in pts if p["kp"] in now]
                    if len(known) < least:
                        continue
                    got = robust_homography(np.array([[p["x"], p["y"]] for p in known], float), np.array([now[p["kp"]] for p in known], float), threshold)
                    if got is not None:
                        put = apply_homography(got[0], np.array([[p["x"], p["y"]] for p in pts], float))
                        out += [(int(p["kp"]), float(x), float(y)) for p, (x, y) in zip(pts, put, strict=True)]
                yield pd.DataFrame(out, columns=["kp", "x", "y"])

        every = every.union(rows.mapInPandas(run, "kp int, x double, y double"))
        med = every.groupBy("kp").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()  # one row per landmark
        template = {r["kp"]: (r["x"], r["y"]) for r in med}
    return template
