"""Ball track, shot attempts and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class ShotConfig:
    max_gap: int = 10
    min_coverage: float = 0.40
    horizontal_window: float = 1.8
    timeout: int = 60
    cooldown: int = 15


EVENT = "struct<frame:int,outcome:string,ball_x:double,ball_y:double,resolved_frame:int>"


def fill_gaps(ball: DataFrame, max_gap: int, key: str = "clip_id") -> DataFrame:
    """ball(clip, i, bx, by_) with nulls filled linearly in runs of at most max_gap between known points."""
    so_far = lambda by: Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("bx").isNotNull(), F.struct("i", "bx", "by_")), ignorenulls=True)
    # the next known point is the last one when the frames are read backwards
    out = ball.withColumns({"_p": known.over(so_far("i")), "_n": known.over(so_far(F.desc("i")))})
    span = F.col("_n.i") - F.col("_p.i")
    share = F.when((span > 0) & (span - 1 <= max_gap), (F.col("i") - F.col("_p.i")) / span)
    fill = lambda c: F.coalesce(F.col(c), F.col(f"_p.{c}") + share * (F.col(f"_n.{c}") - F.col(f"_p.{c}")))
    return out.withColumns({"bx": fill("bx"), "by_": fill("by_")}).drop("_p", "_n")


def best_detection(detections: DataFrame, key: list[str]) -> DataFrame:
    """The most confident detection per class and frame, the first of equals."""
    w = Window.partitionBy(*key, "class_name").orderBy(F.desc("conf"), "ord")
    return detections.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rim_box(rims: DataFrame, least: int = 5, key: str = "clip_id") -> DataFrame:
    """The median rim box of a clip, null with fewer than ``least`` hits."""
    med = {c: F.median(f"box.{c}") for c in ("x1", "y1", "x2", "y2")}
    agg = rims.groupBy(key).agg(*[v.alias(c) for c, v in med.items()], F.count(F.lit(1)).alias("_n"))
    return agg.select(key, F.when(F.col("_n") >= least, F.struct("x1", "y1", "x2", "y2")).alias("rim"))


def _fold(track: Column, rim: Column, cfg: ShotConfig) -> Column:
    """Runs the attempt state machine over the ordered track; open attempts count as missed."""
    cx, cy = (rim["x1"] + rim["x2"]) / 2, (rim["y1"] + rim["y2"]) / 2
    reach = cfg.horizontal_window * F.greatest(rim["x2"] - rim["x1"], F.lit(1.0))
    start = F.struct(
        F.lit(-1).alias("open"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(-1).alias("cool"),
        F.lit(None).cast("double").alias("py"), F.array().cast(f"array<{EVENT}>").alias("ev"),
    )

    def state(open_, sx, sy, cool, py, ev) -> Column:
        return F.struct(open_.cast("int").alias("open"), sx.alias("sx"), sy.alias("sy"), cool.cast("int").alias("cool"), py.alias("py"), ev.alias("ev"))

    def event(a: Column, made: Column, at: Column) -> Column:
        return F.struct(
            a["open"].alias("frame"), F.when(made, "made").otherwise("missed").alias("outcome"),
            a["sx"].alias("ball_x"), a["sy"].alias("ball_y"), at.cast("int").alias("resolved_frame"),
        )

    def step(a: Column, r: Column) -> Column:
        x, y, i = r["bx"], r["by_"], r["i"]
        near = F.abs(x - cx) <= reach
        made = F.coalesce((a["py"] <= cy) & (cy < y), F.lit(False)) & x.between(rim["x1"], rim["x2"])
        over = made | (i - a["open"] > cfg.timeout) | (~near & (y > cy))
        idle = a["open"] < 0
        return (
            F.when(x.isNull(), state(a["open"], a["sx"], a["sy"], a["cool"], F.lit(None).cast("double"), a["ev"]))
            .when(idle & near & (y < rim["y1"]) & (i >= a["cool"]), state(i, x, y, a["cool"], y, a["ev"]))
            .when(~idle & over, state(F.lit(-1), a["sx"], a["sy"], i + cfg.cooldown, y, F.array_append(a["ev"], event(a, made, i))))
            .otherwise(state(a["open"], a["sx"], a["sy"], a["cool"], y, a["ev"]))
        )

    last = F.size(track) - 1
    return F.aggregate(
        track, start, step, lambda a: F.when(a["open"] >= 0, F.array_append(a["ev"], event(a, F.lit(False), last))).otherwise(a["ev"])
    )


def detect_shots(ball: DataFrame, rims: DataFrame, cfg: ShotConfig = ShotConfig(), key: str = "clip_id") -> DataFrame:
    """One row per clip: n, coverage, available, reason and events.

    ball(clip, i, bx, by_) is dense: one row per processed frame, nulls without a ball. The
    track of a clip is one ordered array, bounded by the clip's frames, and is folded in the JVM.
    """
    filled = fill_gaps(ball, cfg.max_gap, key)
    tracks = filled.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("i", "bx", "by_"))).alias("track"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col("bx").isNotNull().cast("int")).alias("coverage"),
    )
    t = tracks.join(rims.select(key, "rim"), key, "left")
    low = F.col("coverage") < cfg.min_coverage
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    reason = F.when(F.col("rim").isNull(), "no rim detected").when(
        low, F.concat(F.lit("ball track coverage "), percent(F.col("coverage")), F.lit(" < "), percent(F.lit(cfg.min_coverage)), F.lit(" quality gate"))
    )
    t = t.withColumns({"reason": reason, "available": reason.isNull()})
    events = F.when(F.col("available"), _fold(F.col("track"), F.col("rim"), cfg)).otherwise(F.array().cast(f"array<{EVENT}>"))
    return t.select(key, "n", F.when(F.col("rim").isNotNull(), F.col("coverage")).otherwise(0.0).alias("coverage"), "available", "reason", events.alias("events"))


def shot_events(found: DataFrame, fps: Column, key: str = "clip_id") -> DataFrame:
    """The events of detect_shots as rows, with their time."""
    e = found.select(key, F.explode("events").alias("e"))
    return e.select(key, "e.frame", (F.col("e.frame") / fps).alias("time_s"), "e.outcome", "e.ball_x", "e.ball_y", "e.resolved_frame")


def shooters(events: DataFrame, players: DataFrame, reach: float = 180.0, key: list[str] = ["clip_id", "frame"]) -> DataFrame:  # noqa: B006
    """events with the track_id of the player whose box centre is nearest to the ball, strictly within reach."""
    c = g.center(F.col("box"))
    near = players.select(*key, "track_id", "ord", c.alias("c"))
    met = events.join(near, key).withColumn("d", g.distance(F.col("c.x"), F.col("c.y"), F.col("ball_x"), F.col("ball_y"))).filter(F.col("d") < reach)
    best = met.groupBy(*key).agg(F.min(F.struct("d", "ord", "track_id")).alias("b")).select(*key, F.col("b.track_id").alias("shooter_track_id"))
    return events.join(best, key, "left")


def match_events(events: DataFrame, truths: DataFrame, tolerance: float = 2.0, key: str = "clip_id") -> DataFrame:
    """Greedy one-to-one matches in time order: (clip, event_ord, truth_ord), unmatched sides with a null.

    Candidate pairs come from an equi-join on time cells one tolerance wide and their
    neighbours. Each event, earliest first, takes the nearest truth not yet taken, the
    first listed of equals.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    e = events.select(key, "event_ord", F.col("time_s").alias("te"), F.explode(F.array(*[cell("time_s") + d for d in (-1, 0, 1)])).alias("cell"))
    t = truths.select(key, "truth_ord", F.col("time_s").alias("tt"), cell("time_s").alias("cell"))
    near = e.join(t, [key, "cell"]).withColumn("d", F.abs(F.col("te") - F.col("tt"))).filter(F.col("d") <= tolerance)
    per = near.groupBy(key, "te", "event_ord").agg(F.array_sort(F.collect_list(F.struct("d", "truth_ord"))).alias("c"))
    # events more than two tolerances apart share no truth, so each run of closer ones is matched by itself
    w = Window.partitionBy(key).orderBy("te", "event_ord")
    per = per.withColumn("_new", F.coalesce(F.col("te") - F.lag("te").over(w) > 2 * tolerance, F.lit(True)).cast("int"))
    per = per.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = per.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("te", "event_ord", "c"))).alias("todo"))
    lists = lists.select(key, F.transform("todo", lambda r: r["event_ord"].cast("long")).alias("e"), F.transform("todo", lambda r: F.transform(r["c"], lambda c: c["truth_ord"].cast("long"))).alias("t"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for clip, es, near_ in zip(pdf[key], pdf["e"], pdf["t"], strict=True):
                taken: set = set()
                for e_, ts in zip(es, near_, strict=True):
                    free = next((x for x in ts if x not in taken), None)
                    if free is not None:
                        taken.add(free)
                        out.append((clip, e_, free))
            yield pd.DataFrame(out, columns=[key, "event_ord", "truth_ord"])

    kind = events.schema[key].dataType.simpleString()
    pairs = lists.mapInPandas(take, f"{key} {kind}, event_ord long, truth_ord long")
    all_e = events.select(key, F.col("event_ord").cast("long").alias("event_ord"))
    all_t = truths.select(key, F.col("truth_ord").cast("long").alias("truth_ord"))
    lost = all_e.join(pairs, [key, "event_ord"], "left_anti").withColumn("truth_ord", F.lit(None).cast("long"))
    missed = all_t.join(pairs, [key, "truth_ord"], "left_anti").select(key, F.lit(None).cast("long").alias("event_ord"), "truth_ord")
    return pairs.unionByName(lost).unionByName(missed)


def shot_scores(matches: DataFrame, events: DataFrame, truths: DataFrame, key: str = "clip_id") -> DataFrame:
    """tp, fp, fn, correct outcomes, precision, recall and outcome accuracy over all clips; 0 on empty denominators."""
    m = matches.join(events.select(key, "event_ord", F.col("outcome").alias("oe")), [key, "event_ord"], "left")
    m = m.join(truths.select(key, "truth_ord", F.col("outcome").alias("ot")), [key, "truth_ord"], "left")
    both = F.col("event_ord").isNotNull() & F.col("truth_ord").isNotNull()
    out = m.agg(
        F.count_if(both).alias("tp"), F.count_if(F.col("truth_ord").isNull()).alias("fp"), F.count_if(F.col("event_ord").isNull()).alias("fn"),
        F.count_if(both & (F.col("oe") == F.col("ot"))).alias("outcomes_ok"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")),
        "outcome_accuracy": rate(F.col("outcomes_ok"), F.col("tp")),
    })
