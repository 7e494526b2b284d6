"""Whole analyses composed of the operators. Every step is a plan; nothing runs before a result is read.

Results that several later steps read are persisted, as each function says; unpersist() frees them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxscore, identity, paths, registration, segments, shots, stitch


@dataclass
class Analysis:
    """Named result tables, and the intermediate ones that are kept for them."""

    tables: dict[str, DataFrame]
    kept: list[DataFrame] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def unpersist(self) -> None:
        for df in self.kept:
            df.unpersist()


def fixed_camera(
    boxes: DataFrame, detections: DataFrame, frames: DataFrame, fps: float, homography: Column | None = None,
    features: DataFrame | None = None, rule: stitch.PixelRule | None = None, cfg: shots.ShotConfig = shots.ShotConfig(),
) -> Analysis:
    """A static clip: shot events with shooters and court places, movement statistics, occupancy.

    boxes(clip_id, i, frame, track_id, box, ord, team), detections(clip_id, i, frame, class_name, conf, box, ord),
    frames(clip_id, i, frame). Stitching needs features(clip_id, track_id, feature).
    """
    kept = []
    if features is not None:
        remap = stitch.link(stitch.tracklets(boxes, features), rule or stitch.PixelRule())
        boxes = identity.remapped(boxes, remap).persist()
        kept.append(boxes)
    best = shots.best_detection(detections, ["clip_id", "i"])
    rims = shots.rim_box(best.filter("class_name = 'rim'").select("clip_id", "box"))
    c = g.center(F.col("box"))
    balls = best.filter("class_name = 'ball'").select("clip_id", "i", c["x"].alias("bx"), c["y"].alias("by_"))
    dense = frames.select("clip_id", "i").join(balls, ["clip_id", "i"], "left")
    found = shots.detect_shots(dense, rims, cfg)
    events = shots.shot_events(found, F.lit(fps)).withColumnRenamed("frame", "i")
    shooter = shots.shooters(events, boxes.select("clip_id", "i", "track_id", "ord", "box"), key=["clip_id", "i"])
    tables = {"boxes": boxes, "shots": found, "rims": rims}
    if homography is not None:
        near = boxes.select("clip_id", "i", F.col("track_id").alias("shooter_track_id"), "team", g.foot(F.col("box")).alias("_f"))
        e = shooter.join(near, ["clip_id", "i", "shooter_track_id"], "left")
        # where the shooter stands, or the ball if nobody is near
        p = g.project(homography, F.coalesce("_f.x", "ball_x"), F.coalesce("_f.y", "ball_y"))
        shooter = e.withColumn("court_xy", g.point(F.round(p["x"], 2), F.round(p["y"], 2))).drop("_f")
        on_court = paths.court_positions(boxes, homography, F.lit(fps))
        tables |= {"stats": paths.movement_stats(on_court), "occupancy": paths.occupancy(on_court)}
    return Analysis(tables | {"events": shooter}, kept)


def court_tracks(boxes: DataFrame, registered: DataFrame, fps: float, margin: float = 2.0) -> DataFrame:
    """Feet of boxes on the full court by the homography of their frame; frames without one drop out."""
    one = boxes.join(registered.filter("h is not null"), ["clip_id", "frame"])
    f = g.foot(F.col("box"))
    p = one.withColumn("_p", g.project(F.col("h"), f["x"], f["y"]))
    x, y = F.col("_p.x"), F.col("_p.y")
    return p.filter(g.in_full_court(x, y, margin)).withColumns({"x": x, "y": y, "t": g.seconds(F.col("frame"), F.lit(fps))}).drop("_p", "h")


def panning_camera(
    boxes: DataFrame, keypoints: DataFrame, frames: DataFrame, reads: DataFrame, fps: float, features: DataFrame | None = None,
    rule: stitch.CourtRule | None = None, min_votes: int = 3, min_frames: int = 15, abstain: str = "unreadable",
) -> Analysis:
    """A panning clip: registration, court positions, stitching on the court, numbers, statistics with numbers.

    boxes(clip_id, frame, track_id, box, ord, team), keypoints(clip_id, frame, kp, x, y, conf), frames(clip_id, frame),
    reads(clip_id, frame, read_id, box, number). Positions and stitched boxes are persisted: three steps read them.
    """
    registered = registration.registered(keypoints, frames).persist()
    placed = court_tracks(boxes, registered, fps).persist()
    named = identity.without_abstentions(reads, abstain)
    remap = None
    if features is not None:
        # tracklets in feet: a point is a box without size
        feet = placed.select("clip_id", "track_id", F.col("frame").alias("i"), g.box(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("box"), "ord")
        remap = stitch.link(stitch.tracklets(feet, features), rule or stitch.CourtRule(fps=fps))
    after = (lambda df: identity.remapped(df, remap)) if remap is not None else (lambda df: df)
    stitched, spans = after(boxes).persist(), identity.spans_of(after(boxes))
    merged, numbers = identity.identify(named, stitched, spans, min_votes=min_votes)
    where = identity.remapped(after(placed), merged)
    stats = paths.movement_stats(where, min_frames)
    players = stats.join(numbers, ["clip_id", "track_id"], "left")
    votes = identity.match_reads(named, stitched)
    return Analysis(
        {
            "registered": registered, "rate": registration.registration_rate(registered), "positions": where, "players": players, "numbers": numbers,
            "telemetry": identity.telemetry(named, votes, numbers, spans, where), "occupancy": paths.occupancy(where, 94, 50),
        },
        [registered, placed, stitched],
    )


def analysable_segments(samples: DataFrame, fps: float, fine_until_s: float | None = None, **kw) -> DataFrame:
    """The segments of a coarse pass that the fine pass works on, numbered in order."""
    from pyspark.sql import Window

    found = segments.segments(samples, F.lit(fps), **kw)
    if fine_until_s is not None:
        found = found.filter(F.col("start_frame") / fps < fine_until_s)
    return found.withColumn("segment", F.row_number().over(Window.partitionBy("clip_id").orderBy("start_frame")) - 1)


def in_segments(rows: DataFrame, found: DataFrame, cell: int = 9000) -> DataFrame:
    """rows(clip_id, frame, …) that lie in a segment, with its number.

    The range join becomes an equi-join on cells of frames; a segment is listed once per cell it touches.
    """
    s = found.select("clip_id", "segment", "start_frame", "end_frame", F.explode(F.sequence(F.floor(F.col("start_frame") / cell), F.floor(F.col("end_frame") / cell))).alias("_c"))
    met = rows.withColumn("_c", F.floor(F.col("frame") / cell)).join(s, ["clip_id", "_c"])
    return met.filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).drop("_c", "start_frame", "end_frame")


def full_game(samples: DataFrame, tables: dict[str, DataFrame], fps: float, fine_until_s: float | None = None, **kw) -> Analysis:
    """A broadcast: segments, the panning analysis of each with a state of its own, totals per number.

    tables holds boxes, keypoints, frames and reads of the whole game. Segments are the unit of parallel work: each is
    a clip of its own, named clip/segment, in one plan over all of them.
    """
    found = analysable_segments(samples, fps, fine_until_s, **kw)
    cut = {}
    for name, df in tables.items():
        part = in_segments(df, found)
        cut[name] = part.withColumn("clip_id", F.concat_ws("/", F.col("clip_id").cast("string"), F.col("segment").cast("string"))).drop("segment")
    one = panning_camera(cut["boxes"], cut["keypoints"], cut["frames"], cut["reads"], fps)
    rows = one["players"].withColumn("segment", F.substring_index("clip_id", "/", -1).cast("int"))
    dups = identity.duplicated_numbers(one["numbers"])
    meta = segments.coverage(samples).join(segments.analysable(found), "clip_id", "left")
    return Analysis(
        {
            "segments": found, "meta": meta, "players": rows, "totals": boxscore.number_totals(rows), "identified": boxscore.identified_time(rows),
            "duplicates": identity.duplicates_over_segments(dups),
        },
        one.kept,
    )
