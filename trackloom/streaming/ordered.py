"""Ordered folds on streams whose rows come in any order within the watermark.

Rows of a key wait in list state until the watermark has passed them, and are then folded in order of their number. An
event-time timer wakes the key when the watermark reaches what still waits, so nothing needs further input of the same key.
If a key then stays silent for ``idle``, its last segment is finished and its state goes. Rows that come
later than the watermark allows never reach a key: Spark drops and counts them (late_rows()).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.registration import RegistrarRule
from ..operators.shots import ShotConfig

Fold = Callable[[dict, int, dict], list[tuple]]
ROW = StructType([StructField(c, LongType()) for c in ("ts", "seq", "segment")] + [StructField("row", StringType())])
HELD = StructType([StructField("state", StringType()), StructField("segment", LongType()), StructField("last", LongType())])


class OrderedFold(StatefulProcessor):
    """fold(state, seq, row) and finish(state) return output rows and change the state, a dict that JSON can hold."""

    def __init__(self, key: str, columns: list[str], fold: Fold, finish: Callable[[dict], list[tuple]], output: list[str], idle_ms: int):
        self.key, self.columns, self.fold, self.finish, self.output, self.idle = key, columns, fold, finish, output, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.state = handle.getValueState("state", HELD)

    def _held(self) -> tuple[dict, int | None, int]:
        got = self.state.get() if self.state.exists() else None
        return (json.loads(got[0]), got[1], got[2]) if got else ({}, None, -1)

    def _advance(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed and keep the rest; set the next timer."""
        ready = sorted((r for r in rows if r[0] < watermark), key=lambda r: (r[2], r[1], r[0], r[3]))
        rest = [r for r in rows if r[0] >= watermark]
        state, segment, last = self._held()
        out = []
        for ts, seq, seg, row in ready:
            if segment is not None and seg != segment:
                out += self.finish(state)
                state = {}
            segment, last = seg, max(last, ts)
            out += self.fold(state, seq, json.loads(row))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if not rest and segment is not None and last + self.idle < watermark:
            out += self.finish(state)
            self.state.clear()
            self.waiting.clear()
        else:
            if segment is not None:
                self.state.update((json.dumps(state), segment, last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.handle.registerTimer(max(watermark, 0) + 1 if not rest and last < 0 else (min(r[0] for r in rest) + 1 if rest else last + self.idle + 1))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=[self.key, *self.output])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            if pdf.empty:  # a key that only a timer woke
                continue
            values = [[None if pd.isna(v) else v for v in col] for col in (pdf[c].tolist() for c in self.columns)]
            for ts, seq, seg, *v in zip(pdf["row_ts"].tolist(), pdf["row_seq"].tolist(), pdf["row_segment"].tolist(), *values, strict=True):
                new.append((ts, seq, seg, json.dumps(dict(zip(self.columns, v, strict=True)))))
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ordered_fold(
    rows: DataFrame, key: str, columns: list[str], fold: Fold, finish: Callable[[dict], list[tuple]], output: str, late: str, idle_ms: int, seq: str = "i", segment: str | None = None
) -> DataFrame:
    """Stream rows(key, ts, seq, …) folded per key in order of (segment, seq). output: DDL of what the fold returns."""
    seg = F.col(segment).cast("long") if segment else F.lit(0).cast("long")
    timed = rows.withWatermark("ts", late)
    ready = timed.select(F.col(key), "ts", F.unix_millis("ts").alias("row_ts"), F.col(seq).cast("long").alias("row_seq"), seg.alias("row_segment"), *columns)
    names = StructType.fromDDL(output).names
    kind = rows.schema[key].dataType.simpleString()
    work = OrderedFold(key, columns, fold, finish, names, idle_ms)
    return ready.groupBy(key).transformWithStateInPandas(work, f"{key} {kind}, {output}", "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query has dropped because they came after the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


SHOT = "frame int, outcome string, ball_x double, ball_y double, resolved_frame int"


def live_shots(ball: DataFrame, rim: tuple[float, float, float, float], cfg: ShotConfig = ShotConfig(), late: str = "10 seconds", idle_ms: int = 60_000, segment: str | None = None) -> DataFrame:
    """Shot attempts of a stream of ball(clip_id, ts, i, bx, by_), as the batch operator finds them without gap filling.

    An attempt that is open when its segment ends is reported as missed, resolved by the segment's last frame.
    """
    x1, y1, x2, y2 = rim
    cx, cy, reach = (x1 + x2) / 2, (y1 + y2) / 2, cfg.horizontal_window * max(x2 - x1, 1.0)

    def fold(s: dict, i: int, row: dict) -> list[tuple]:
        s["last"] = i
        x, y, before = row["bx"], row["by_"], s.get("y")
        s["y"] = y if x is not None else None
        if x is None:
            return []
        near = abs(x - cx) <= reach
        if "open" not in s:
            if near and y < y1 and i >= s.get("cool", -1):
                s["open"] = [i, x, y]
            return []
        made = before is not None and before <= cy < y and x1 <= x <= x2
        if not (made or i - s["open"][0] > cfg.timeout or (not near and y > cy)):
            return []
        at, bx, by = s.pop("open")
        s["cool"] = i + cfg.cooldown
        return [(at, "made" if made else "missed", bx, by, i)]

    def finish(s: dict) -> list[tuple]:
        return [(s["open"][0], "missed", s["open"][1], s["open"][2], s["last"])] if "open" in s else []

    return ordered_fold(ball, "clip_id", ["bx", "by_"], fold, finish, SHOT, late, idle_ms, segment=segment)


def live_averages(values: DataFrame, rule: RegistrarRule = RegistrarRule(), late: str = "10 seconds", idle_ms: int = 60_000, segment: str | None = None) -> DataFrame:
    """The registrar's smoothing on a stream of values(clip_id, ts, i, v): (clip_id, i, e, misses), one row a frame.

    e averages the known values exponentially; a null v keeps it, and after more than max_misses nulls in a row
    it is forgotten, so that the next known value starts anew.
    """

    def fold(s: dict, i: int, row: dict) -> list[tuple]:
        v = row["v"]
        if v is None:
            s["misses"] = s.get("misses", 0) + 1
            if s["misses"] > rule.max_misses:
                s.pop("e", None)
        else:
            s["e"] = v if "e" not in s else (1 - rule.alpha) * s["e"] + rule.alpha * v
            s["misses"] = 0
        return [(i, s.get("e"), s["misses"])]

    return ordered_fold(values, "clip_id", ["v"], fold, lambda s: [], "i long, e double, misses long", late, idle_ms, segment=segment)
