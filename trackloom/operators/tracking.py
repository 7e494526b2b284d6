"""Multi-object tracking: detections of a frame joined to the tracks of the frames before.

A track is a constant-velocity Kalman state of its box. In each frame the confident boxes are
assigned to all living tracks first; then what is left of the tracks that were seen in the frame before may
take boxes of low confidence. A confident box that no track takes starts one. A track that has not been
seen for more than ``keep`` frames ends.

A clip is cut wherever that long no box was seen, since no track lives across such a gap. The pieces are
independent and dealt to tasks one by one. A task goes through its pieces in blocks of rows, all pieces of a block
a frame on at once; of a piece longer than a block only the living tracks are kept. Track ids follow from the pieces' order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geometry as g
from .evaluation import assignment

PAIRS = 1_000_000  # pairs of a track and a box that are compared at a time


@dataclass(frozen=True)
class TrackRule:
    """high, low: confidence of boxes that start and prolong tracks; overlap, low_overlap: least IoU with a track's
    predicted box in either round; keep: frames that a track lives unseen; position, velocity: noise as parts of the box height."""

    high: float = 0.5
    low: float = 0.1
    overlap: float = 0.2
    low_overlap: float = 0.5
    keep: int = 30
    position: float = 0.05
    velocity: float = 0.00625


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes (cx, cy, w, h), row by row."""
    w, h = (np.minimum(a[:, k] + a[:, k + 2] / 2, b[:, k] + b[:, k + 2] / 2) - np.maximum(a[:, k] - a[:, k + 2] / 2, b[:, k] - b[:, k + 2] / 2) for k in (0, 1))
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0)


def _near(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, IoU) of the pairs of one piece that overlap enough; of_a and of_b are the pieces, the latter in order."""
    first = np.searchsorted(of_b, of_a)
    n = np.searchsorted(of_b, of_a, "right") - first
    found = []
    for rows in np.array_split(np.arange(len(a)), 1 + int(n.sum()) // PAIRS):
        m = n[rows]
        i, j = np.repeat(rows, m), np.arange(m.sum()) + np.repeat(first[rows] - (np.cumsum(m) - m), m)
        iou = _iou(a[i], b[j])
        near = iou >= least
        found.append((i[near], j[near], iou[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rows(n: int = 0) -> np.ndarray:
    return np.zeros((n, 4))


@dataclass
class Tracks:
    """The living tracks of some pieces: the four box values each have a position, a velocity and their covariance.

    Frames count from the last one before the block of rows (steps); a piece's tracks are in order of their ids.
    """

    rule: TrackRule
    last: int | None = None
    started: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    piece: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    x: np.ndarray = field(default_factory=_rows)
    v: np.ndarray = field(default_factory=_rows)
    pxx: np.ndarray = field(default_factory=_rows)
    pxv: np.ndarray = field(default_factory=_rows)
    pvv: np.ndarray = field(default_factory=_rows)

    _PER_TRACK = ("piece", "id", "seen", "x", "v", "pxx", "pxv", "pvv")

    def _select(self, keep: np.ndarray) -> None:
        if not keep.all():
            for name in self._PER_TRACK:
                setattr(self, name, getattr(self, name)[keep])

    def _predict(self) -> None:
        """One frame on. The four values do not mix, so the filter is four filters of two values."""
        h = np.maximum(self.x[:, 3:], 1.0)
        self.x = self.x + self.v
        self.pxx = self.pxx + 2 * self.pxv + self.pvv + (self.rule.position * h) ** 2
        self.pxv = self.pxv + self.pvv
        self.pvv = self.pvv + (self.rule.velocity * h) ** 2

    def _update(self, step: int, at: np.ndarray, box: np.ndarray) -> None:
        h = np.maximum(box[:, 3:], 1.0)
        s = self.pxx[at] + (self.rule.position * h) ** 2
        gain_x, gain_v = self.pxx[at] / s, self.pxv[at] / s
        off = box - self.x[at]
        self.x[at] += gain_x * off
        self.v[at] += gain_v * off
        self.pvv[at] -= gain_v * self.pxv[at]
        self.pxx[at], self.pxv[at] = (1 - gain_x) * self.pxx[at], (1 - gain_x) * self.pxv[at]
        self.seen[at] = step

    def _start(self, step: int, piece: np.ndarray, box: np.ndarray) -> np.ndarray:
        n, h = len(box), np.maximum(box[:, 3:], 1.0) * np.ones((1, 4))
        ids = self.started[piece] + 1 + np.arange(n) - np.searchsorted(piece, piece)
        self.started += np.bincount(piece, minlength=len(self.started))
        new = (piece, ids, np.full(n, step), box, _rows(n), (2 * self.rule.position * h) ** 2, _rows(n), (10 * self.rule.velocity * h) ** 2)
        for name, value in zip(self._PER_TRACK, new, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), value]))
        return ids

    def _take(self, step: int, tracks: np.ndarray, piece: np.ndarray, box: np.ndarray, boxes: np.ndarray, least: float, out: np.ndarray) -> np.ndarray:
        """Assign boxes (places in box) to tracks (places) of their pieces and return the tracks that got none."""
        if not len(tracks) or not len(boxes):
            return tracks
        of_t, of_b = self.piece[tracks], piece[boxes]
        t, b, iou = _near(self.x[tracks], of_t, box[boxes], of_b, least)
        sure = (np.bincount(t, minlength=len(tracks))[t] == 1) & (np.bincount(b, minlength=len(boxes))[b] == 1)  # no choice there
        pairs = [(t[sure], b[sure])]
        t, b, iou = t[~sure], b[~sure], iou[~sure]
        for p in np.unique(of_t[t]):
            rows, cols, here = np.flatnonzero(of_t == p), np.flatnonzero(of_b == p), of_t[t] == p
            cost = np.full((len(rows), len(cols)), np.inf)
            cost[np.searchsorted(rows, t[here]), np.searchsorted(cols, b[here])] = 1 - iou[here]
            found = np.array(assignment(cost), int).reshape(-1, 2)
            pairs.append((rows[found[:, 0]], cols[found[:, 1]]))
        t, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        self._update(step, tracks[t], box[boxes[b]])
        out[boxes[b]] = self.id[tracks[t]]
        return np.delete(tracks, t)

    def advance(self, step: int, piece: np.ndarray, box: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """The track id of each box (cx, cy, w, h) of a step, in order of pieces; 0 for none."""
        rule, out = self.rule, np.zeros(len(box), np.int64)
        high, low = np.flatnonzero(conf >= rule.high), np.flatnonzero((conf >= rule.low) & (conf < rule.high))
        rest = self._take(step, np.arange(len(self.id)), piece, box, high, rule.overlap, out)
        self._take(step, rest[self.seen[rest] == step - 1], piece, box, low, rule.low_overlap, out)
        new = high[out[high] == 0]
        out[new] = self._start(step, piece[new], box[new])
        return out

    def block(self, piece: np.ndarray, frame: np.ndarray, box: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Track ids from 1 of the rows of whole pieces 0, 1, 2..., in order of piece and frame; 0 for none. Piece 0 goes on
        where the block before ended, and may itself go on if it is the only one."""
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        base = frame[first] - 1
        base[0] = base[0] if self.last is None else self.last
        step, end = frame - base[piece], np.append(frame[first[1:] - 1], frame[-1]) - base
        self.started = np.concatenate([self.started, np.zeros(len(first) - 1, np.int64)])
        out, order, now = np.zeros(len(piece), np.int64), np.lexsort((piece, step)), 0
        cut = np.flatnonzero(np.diff(step[order], prepend=0))
        for at in np.split(order, cut[1:]):
            to = int(step[at[0]])
            while now < to:
                now += 1
                self._select(end[self.piece] >= now)
                if not len(self.id):
                    now = to
                    break
                self._predict()
                self._select(now - self.seen <= self.rule.keep + 1)
            out[at] = self.advance(to, piece[at], box[at], conf[at])
        self.last = int(frame[-1])
        self.seen -= now
        return out


def followed(batches: Iterable[pa.RecordBatch], rule: TrackRule) -> Iterator[pa.RecordBatch]:
    """The rows (clip_id, piece, frame, conf, cx, cy, w, h, ...), in that order, that belong to a track, with its id within the piece.

    What may go on in the next batch is held: the last piece, or the last frame if there is only one piece.
    """
    tracks, held = Tracks(rule), None
    for batch in chain(batches, [None]):
        rows = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
        if rows is None or not rows.num_rows:
            continue
        col = {c: rows[c].to_numpy(zero_copy_only=False) for c in ("piece", "frame", "conf", "cx", "cy", "w", "h")}
        new = (np.diff(rows["clip_id"].dictionary_encode("encode").indices.to_numpy(), prepend=0) != 0) | (np.diff(col["piece"], prepend=col["piece"][0]) != 0)
        piece, n = np.cumsum(new), rows.num_rows
        if batch is not None:
            n = int(np.searchsorted(piece, piece[-1]) or np.searchsorted(col["frame"], col["frame"][-1]))
        held = rows.slice(n)
        if not n:
            continue
        ids = tracks.block(piece[:n], col["frame"][:n], np.stack([col[c][:n] for c in ("cx", "cy", "w", "h")], 1), col["conf"][:n])
        if piece[-1]:
            tracks = Tracks(rule)
        out = pa.RecordBatch.from_arrays([*rows.slice(0, n).columns, pa.array(ids)], names=[*rows.schema.names, "local"])
        yield out.filter(pa.array(ids > 0))


def pieces(detections: DataFrame, rule: TrackRule) -> DataFrame:
    """detections with piece: a number that grows where a clip has no usable box for longer than a track lives."""
    frames = detections.where(F.col("conf") >= rule.low).select("clip_id", "frame").distinct()
    w = Window.partitionBy("clip_id").orderBy("frame")
    new = F.col("frame") - F.lag("frame").over(w) > rule.keep + 1
    frames = frames.withColumn("piece", F.sum(F.coalesce(new, F.lit(False)).cast("long")).over(w))
    return detections.join(frames, ["clip_id", "frame"])


def track(detections: DataFrame, rule: TrackRule = TrackRule()) -> DataFrame:
    """detections(clip_id, frame, det_ord, box, conf) that belong to a track, with track_id, from 1 within a clip.

    Tracks are numbered by the frame they start in, then by det_ord. Boxes with a null part or a null
    confidence are left out, as are those that no track takes.
    """
    b = F.col("box")
    usable = detections.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("det_ord").cast("long").alias("det_ord"), "box", F.col("conf").cast("double").alias("conf"))
    usable = usable.where((F.col("conf") >= min(rule.low, rule.high)) & ~F.isnan("conf") & (b["x1"] + b["y1"] + b["x2"] + b["y2"]).isNotNull())
    rows = pieces(usable, rule).repartition("clip_id", "piece").sortWithinPartitions("clip_id", "piece", "frame", "det_ord")
    center = g.center(b)
    sides = {"cx": center["x"], "cy": center["y"], "w": b["x2"] - b["x1"], "h": b["y2"] - b["y1"]}
    rows = rows.select("clip_id", "piece", "frame", "det_ord", "box", "conf", *[v.cast("double").alias(k) for k, v in sides.items()])
    found = rows.mapInArrow(lambda batches: followed(batches, rule), StructType([*rows.schema.fields, StructField("local", LongType())]))
    # a track's rows share its rank, and every number within a piece has rows: the tracker runs once, nothing is joined back
    rank = F.dense_rank().over(Window.partitionBy("clip_id").orderBy("piece", "local"))
    return found.select("clip_id", "frame", "det_ord", "box", "conf", rank.cast("long").alias("track_id"))
