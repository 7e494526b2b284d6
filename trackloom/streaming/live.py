"""The ordered operators on streams. Batch results do not depend on these."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.shots import ShotConfig

EVENTS = "clip_id long, frame int, outcome string, ball_x double, ball_y double, resolved_frame int"
STATE = "open int, sx double, sy double, cool int, py double"


def live_shots(ball: DataFrame, rim: tuple[float, float, float, float], cfg: ShotConfig = ShotConfig()) -> DataFrame:
    """Shot attempts of a stream of ball(clip_id, i, bx, by_), as they resolve.

    Rows of a clip must arrive in order of i across micro-batches; within one they are sorted. Gaps are not
    filled, since that needs the future, and an attempt that is open at the end is not reported.
    """
    x1, y1, x2, y2 = rim
    cx, cy, reach = (x1 + x2) / 2, (y1 + y2) / 2, cfg.horizontal_window * max(x2 - x1, 1.0)

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, sx, sy, cool, py = state.get if state.exists else (-1, 0.0, 0.0, -1, None)
        out = []
        rows = pd.concat(list(parts)).sort_values("i")
        for i, x, y in zip(rows["i"], rows["bx"], rows["by_"], strict=True):
            if pd.isna(x):
                py = None
                continue
            near = abs(x - cx) <= reach
            if open_ < 0:
                if near and y < y1 and i >= cool:
                    open_, sx, sy = int(i), float(x), float(y)
            else:
                made = py is not None and py <= cy < y and x1 <= x <= x2
                if made or i - open_ > cfg.timeout or (not near and y > cy):
                    out.append((key[0], open_, "made" if made else "missed", sx, sy, int(i)))
                    open_, cool = -1, int(i) + cfg.cooldown
            py = float(y)
        state.update((open_, sx, sy, cool, py))
        yield pd.DataFrame(out, columns=["clip_id", "frame", "outcome", "ball_x", "ball_y", "resolved_frame"])

    keyed = ball.select(F.col("clip_id").cast("long").alias("clip_id"), "i", "bx", "by_")
    return keyed.groupBy("clip_id").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def live_occupancy(positions: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts per one-foot cell and time window of a stream of positions(ts, x, y); late rows within ``late`` still count."""
    cells = positions.withWatermark("ts", late).groupBy(F.window("ts", window), F.floor("x").cast("int").alias("bx"), F.floor("y").cast("int").alias("by_"))
    return cells.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "bx", "by_", "n")
