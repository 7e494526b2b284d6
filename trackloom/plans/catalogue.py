"""Registered queries over the adapter views, each with its SQL where SQL can say it.

Floating-point results are rounded to four places as the last step, because the order of
summation differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import courts
from ..functions import geometry as g
from ..operators import boxscore, diagnose, evaluation, identity, labels, paths, registration, segments, shots, stitch, teams
from ..sources import adapters as a
from ..sources.adapters import H, RIM, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PATH_MIN, PATH_CAP = 5, 12.0
CFG = shots.ShotConfig(max_gap=2, timeout=6, cooldown=3)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def r4(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


# --- movement -------------------------------------------------------------------------------------------------------

_STATS = f"""
, n AS (SELECT *, count(*) OVER (PARTITION BY clip_id, track_id) AS n FROM {{src}}),
sm AS (SELECT *, CASE WHEN n < 3 THEN x ELSE avg(x) OVER w END AS sx, CASE WHEN n < 3 THEN y ELSE avg(y) OVER w END AS sy FROM n WHERE n >= {PATH_MIN}
  WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY t, ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
st AS (SELECT *, sqrt(power(sx - lag(sx) OVER w, 2) + power(sy - lag(sy) OVER w, 2)) AS step, t - lag(t) OVER w AS dt FROM sm WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY t, ord)),
ok AS (SELECT *, coalesce(dt > 0 AND step / nullif(dt, 0) <= {PATH_CAP}e0, FALSE) AS ok FROM st),
tm AS (SELECT clip_id, track_id, team, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY c DESC, seen, o) AS r
  FROM (SELECT clip_id, track_id, team, count(*) AS c, min(t) AS seen, min(ord) AS o FROM ok GROUP BY ALL)),
ag AS (SELECT clip_id, track_id, count(*) AS frames, max(t) - min(t) AS seconds, sum(step) FILTER (WHERE ok) AS distance_ft,
  quantile_cont(step / dt, 0.95) FILTER (WHERE ok) AS top FROM ok GROUP BY ALL HAVING count(*) FILTER (WHERE ok) > 0)
SELECT clip_id, track_id, team, frames, round(seconds, 4) AS seconds, round(distance_ft, 4) AS distance_ft,
  round(CASE WHEN seconds > 0 THEN distance_ft / seconds * 0.681818e0 ELSE 0 END, 4) AS avg_speed_mph, round(top * 0.681818e0, 4) AS top_speed_mph
FROM ag JOIN tm USING (clip_id, track_id) WHERE r = 1"""
STAT_COLS = ("seconds", "distance_ft", "avg_speed_mph", "top_speed_mph")


@query("movement_stats", sql("+" + _STATS.format(src="pos").lstrip().lstrip(","), "pos"))
def movement_stats(spark, sf):
    return r4(paths.movement_stats(a.positions(spark, sf), PATH_MIN, cap=PATH_CAP), *STAT_COLS)


def _projected(x: str, y: str) -> tuple[str, str, str]:
    h = [f"{v}e0" for v in H]
    w = f"({h[6]} * {x} + {h[7]} * {y} + {h[8]})"
    return f"({h[0]} * {x} + {h[1]} * {y} + {h[2]}) / {w}", f"({h[3]} * {x} + {h[4]} * {y} + {h[5]}) / {w}", w


_PX, _PY, _ = _projected("((x1 + x2) / 2)", "y2")
_COURT = f"""bp AS (SELECT *, {_PX} AS x, {_PY} AS y, frame / 30e0 AS t, CAST(NULL AS INTEGER) AS team FROM boxes),
ib AS (SELECT * FROM bp WHERE x BETWEEN -2 AND 52 AND y BETWEEN -2 AND 49)"""


@query("player_stats", sql("+" + _COURT + _STATS.format(src="ib").replace(f"<= {PATH_CAP}e0", "<= 900e0"), "boxes"))
def player_stats(spark, sf):
    b = a.boxes(spark, sf).withColumn("team", F.lit(None).cast("int"))
    return r4(paths.player_stats(b, a.matrix(), F.lit(30.0), min_frames=PATH_MIN, cap=900.0), *STAT_COLS)


@query("minimap", sql(f"SELECT clip_id, frame, ord, track_id, round({_PX}, 4) AS x, round({_PY}, 4) AS y FROM boxes WHERE {_PX} BETWEEN -3 AND 53 AND {_PY} BETWEEN -3 AND 50", "boxes"))
def minimap(spark, sf):
    b = a.boxes(spark, sf).withColumn("team", F.lit(None).cast("int"))
    return r4(paths.court_positions(b, a.matrix(), F.lit(30.0), margin=3.0), "x", "y").select("clip_id", "frame", "ord", "track_id", "x", "y")


def _occupancy(w: int, n: int) -> str:
    return sql(f"SELECT CAST(least(floor(x), {w - 1}) AS INTEGER) AS bx, CAST(least(floor(y), {n - 1}) AS INTEGER) AS by_, count(*) AS n FROM pos WHERE x BETWEEN 0 AND {w} AND y BETWEEN 0 AND {n} GROUP BY ALL", "pos")


@query("occupancy_half", _occupancy(50, 47))
def occupancy_half(spark, sf):
    return paths.occupancy(a.positions(spark, sf))


@query("occupancy_full", _occupancy(94, 50))
def occupancy_full(spark, sf):
    return paths.occupancy(a.positions(spark, sf), 94, 50)


def _blur(w: int, n: int, sigma: float) -> str:
    k = paths.kernel(sigma)
    rows = ", ".join(f"({i - len(k) // 2}, {v!r})" for i, v in enumerate(k))
    fold = lambda c, s: f"CAST(CASE WHEN ({c} + d + {2 * s}) % {2 * s} >= {s} THEN {2 * s - 1} - ({c} + d + {2 * s}) % {2 * s} ELSE ({c} + d + {2 * s}) % {2 * s} END AS INTEGER)"
    occ = _occupancy(w, n)
    return f"WITH cells AS ({occ}), kern(d, w) AS (VALUES {rows}), one AS (SELECT {fold('bx', w)} AS bx, by_, sum(n * w) AS n FROM cells, kern GROUP BY 1, 2) SELECT bx, {fold('by_', n)} AS by_, round(sum(n * w), 4) AS n FROM one, kern GROUP BY 1, 2"


@query("smoothed_occupancy", _blur(50, 47, 1.2))
def smoothed_occupancy(spark, sf):
    return r4(paths.smoothed_occupancy(paths.occupancy(a.positions(spark, sf))), "n")


@query("top_trails", sql("SELECT clip_id, track_id, count(*) AS n FROM pos GROUP BY ALL ORDER BY n DESC, clip_id, track_id LIMIT 10", "pos"))
def top_trails(spark, sf):
    """The ten longest paths: the limit is what is asked for."""
    p = a.positions(spark, sf).groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return p.orderBy(F.desc("n"), "clip_id", "track_id").limit(10)


# --- segments -------------------------------------------------------------------------------------------------------

_SEG = """q AS (SELECT *, max(CASE WHEN registered THEN frame END) OVER w AS good, max(CASE WHEN NOT registered THEN frame END) OVER w AS bad FROM samples
  WINDOW w AS (PARTITION BY clip_id ORDER BY frame, registered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN bad > good AND (bad - good) / 1e6 > 86400 THEN 1 ELSE 0 END AS br FROM q WHERE registered),
u AS (SELECT *, sum(br) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM b),
sg AS (SELECT clip_id, min(frame) AS start_frame, max(frame) AS end_frame, (max(frame) - min(frame)) / 1e6 AS duration_s FROM u GROUP BY clip_id, run HAVING (max(frame) - min(frame)) / 1e6 >= 172800)"""


def _segments(spark, sf):
    return segments.segments(a.samples(spark, sf), F.lit(1e6), 172800.0, 86400.0)


@query("segments", sql("+" + _SEG + " SELECT clip_id, start_frame, end_frame, round(duration_s, 4) AS duration_s FROM sg", "samples"))
def segments_query(spark, sf):
    return r4(_segments(spark, sf), "duration_s")


@query("segment_summary", sql("+" + _SEG + " SELECT clip_id, round(sum(round(duration_s, 1)), 4) AS analysable_s, count(*) AS n_segments FROM sg GROUP BY clip_id", "samples"))
def segment_summary(spark, sf):
    return r4(segments.analysable(_segments(spark, sf)), "analysable_s")


@query("coverage", sql("SELECT clip_id, round(coalesce(avg(CAST(registered AS INTEGER)), 0), 4) AS coverage FROM samples GROUP BY clip_id", "samples"))
def coverage(spark, sf):
    return r4(segments.coverage(a.samples(spark, sf)), "coverage")


@query(
    "true_runs",
    sql(
        """+ m AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) - row_number() OVER (PARTITION BY clip_id, bx IS NOT NULL ORDER BY i) AS gr FROM ball)
        SELECT clip_id, min(i) AS start, max(i) AS "end", count(*) AS n FROM m WHERE bx IS NOT NULL GROUP BY clip_id, gr HAVING count(*) >= 2""",
        "ball",
    ),
)
def true_runs(spark, sf):
    return segments.true_runs(a.ball(spark, sf).select("clip_id", "i", F.col("bx").isNotNull().alias("on")))


@query("coarse_pass", sql("SELECT clip_id, i AS frame FROM ball WHERE i % 3 = 0", "ball"))
def coarse_pass(spark, sf):
    return segments.sampled(a.ball(spark, sf).select("clip_id", F.col("i").alias("frame")), 3.0)


@query("window_scan", sql("SELECT clip_id, i AS frame, i - 10 AS i FROM ball WHERE i >= 10 AND i < 40 AND (i - 10) % 2 = 0", "ball"))
def window_scan(spark, sf):
    return segments.window_frames(a.ball(spark, sf).select("clip_id", F.col("i").alias("frame")), 10.0, 1.0, 3.0, 2)


@query("read_frames", sql("+ f AS (SELECT DISTINCT clip_id, frame FROM boxes), q AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS n FROM f) SELECT clip_id, frame FROM q WHERE (n - 1) % 5 = 0", "boxes"))
def read_frames(spark, sf):
    return segments.read_frames(a.boxes(spark, sf).select("clip_id", "frame").distinct(), 5)


# --- box score ------------------------------------------------------------------------------------------------------

_TOTALS = """SELECT number, count(DISTINCT segment) AS segments, round(sum(seconds), 4) AS seconds, round(sum(distance_ft), 4) AS distance_ft, max(top_speed_mph) AS top_speed_mph,
  round(CASE WHEN sum(seconds) > 0 THEN sum(distance_ft) / sum(seconds) * 0.681818e0 ELSE 0 END, 4) AS avg_speed_mph FROM seg WHERE number IS NOT NULL GROUP BY number"""


@query("number_totals", sql(_TOTALS, "seg"))
def number_totals(spark, sf):
    return r4(boxscore.number_totals(a.segment_rows(spark, sf)), "seconds", "distance_ft", "avg_speed_mph")


@query(
    "identified_time",
    sql(
        """+ e AS (SELECT number, sum(seconds) AS s, sum(distance_ft) AS d, count(*) AS n FROM seg GROUP BY number),
        x AS (SELECT count(*) FILTER (WHERE number IS NOT NULL) AS identified_numbers, coalesce(sum(n) FILTER (WHERE number IS NOT NULL), 0)::BIGINT AS identified_rows,
          coalesce(sum(n) FILTER (WHERE number IS NULL), 0)::BIGINT AS anonymous_rows, coalesce(sum(s) FILTER (WHERE number IS NULL), 0) AS anonymous_seconds,
          coalesce(sum(d) FILTER (WHERE number IS NULL), 0) AS anonymous_distance_ft, coalesce(sum(round(s, 1)) FILTER (WHERE number IS NOT NULL), 0) AS ided FROM e)
        SELECT identified_numbers, identified_rows, anonymous_rows, round(anonymous_seconds, 4) AS anonymous_seconds, round(anonymous_distance_ft, 4) AS anonymous_distance_ft,
          round(CASE WHEN ided + anonymous_seconds > 0 THEN ided / (ided + anonymous_seconds) ELSE 0 END, 4) AS identified_time_fraction FROM x""",
        "seg",
    ),
)
def identified_time(spark, sf):
    return r4(boxscore.identified_time(a.segment_rows(spark, sf)), "anonymous_seconds", "anonymous_distance_ft", "identified_time_fraction")


@query("duplicates_over_segments", sql("+ d AS (SELECT segment, number, count(DISTINCT track_id) AS players FROM seg WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT track_id) > 1) SELECT number, max(players) AS players FROM d GROUP BY number", "seg"))
def duplicates_over_segments(spark, sf):
    rows = a.segment_rows(spark, sf).filter("number is not null")
    return identity.duplicates_over_segments(identity.duplicated_numbers(rows, "segment"))


# --- identity -------------------------------------------------------------------------------------------------------

_IOS = """greatest(0e0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0e0, least(b.y2, r.y2) - greatest(b.y1, r.y1))
  / least((b.x2 - b.x1) * (b.y2 - b.y1), (r.x2 - r.x1) * (r.y2 - r.y1))"""
_MATCH = f"""c AS (SELECT r.clip_id, b.track_id, r.frame, r.read_id, r.number, {_IOS} AS s, b.ord FROM reads r JOIN boxes b ON r.clip_id = b.clip_id AND r.frame = b.frame),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame, read_id ORDER BY round(s, 9) DESC, ord DESC) AS rn FROM c WHERE s >= 0.9) WHERE rn = 1)"""
_CONFIRM = (
    _MATCH
    + """, p AS (SELECT clip_id, track_id, number, count(*) AS n, min((frame, read_id)) AS seen FROM m GROUP BY ALL),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY clip_id, track_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY n DESC, seen) AS rn FROM p),
cf AS (SELECT clip_id, track_id, number, n, total FROM k WHERE rn = 1 AND total >= 3 AND n >= 3 AND n >= 0.3 * total)"""
)


def _votes(spark, sf):
    return identity.match_reads(a.reads(spark, sf), a.boxes(spark, sf))


def _confirmed(spark, sf):
    return identity.confirm_numbers(_votes(spark, sf), min_share=0.3)


@query("matched_reads", sql("+" + _MATCH + " SELECT clip_id, track_id, frame, read_id, number FROM m", "boxes", "reads"))
def matched_reads(spark, sf):
    return _votes(spark, sf)


@query("confirmed_numbers", sql("+" + _CONFIRM + " SELECT * FROM cf", "boxes", "reads"))
def confirmed_numbers(spark, sf):
    return _confirmed(spark, sf)


_SPANS = "sp AS (SELECT clip_id, track_id, min(frame) AS s, max(frame) AS e, min(ord) AS ord FROM boxes GROUP BY ALL)"
# tracks of a number in order; the fold keeps the groups so far
_MERGE = f"""{_SPANS}, nb AS (SELECT clip_id, track_id, CAST(track_id % 3 AS VARCHAR) AS number FROM (SELECT DISTINCT clip_id, track_id FROM boxes)),
sh AS (SELECT clip_id, track_id, s, s + 2 + track_id % 4 AS e, ord FROM sp),
td AS (SELECT clip_id, number, track_id, s, e, row_number() OVER (PARTITION BY clip_id, number ORDER BY s, ord) AS j FROM nb JOIN sh USING (clip_id, track_id)),
f AS (SELECT clip_id, number, j, [{{'e': CAST(e AS BIGINT), 'ids': [track_id]}}] AS gs FROM td WHERE j = 1
  UNION ALL SELECT f.clip_id, f.number, td.j, CASE WHEN list_position(list_transform(f.gs, lambda q: td.s > q.e), TRUE) > 0
    THEN list_concat(list_slice(f.gs, 1, list_position(list_transform(f.gs, lambda q: td.s > q.e), TRUE) - 1),
      [{{'e': greatest(f.gs[list_position(list_transform(f.gs, lambda q: td.s > q.e), TRUE)].e, CAST(td.e AS BIGINT)), 'ids': list_append(f.gs[list_position(list_transform(f.gs, lambda q: td.s > q.e), TRUE)].ids, td.track_id)}}],
      list_slice(f.gs, list_position(list_transform(f.gs, lambda q: td.s > q.e), TRUE) + 1, len(f.gs)))
    ELSE list_append(f.gs, {{'e': CAST(td.e AS BIGINT), 'ids': [td.track_id]}}) END
  FROM f JOIN td ON td.clip_id = f.clip_id AND td.number = f.number AND td.j = f.j + 1),
l AS (SELECT *, max(j) OVER (PARTITION BY clip_id, number) AS top FROM f),
g AS (SELECT clip_id, unnest(gs) AS q FROM l WHERE j = top),
mg AS (SELECT clip_id, unnest(q.ids) AS track_id, list_min(q.ids) AS canonical_id FROM g),
rm AS (SELECT * FROM mg UNION ALL SELECT clip_id, track_id, track_id FROM sh WHERE (clip_id, track_id) NOT IN (SELECT (clip_id, track_id) FROM mg))"""


def _merge_inputs(spark, sf):
    """Spans cut short so that some tracks of a number are disjoint."""
    spans = identity.spans_of(a.boxes(spark, sf)).withColumn("end", F.col("start") + 2 + F.col("track_id") % 4)
    return spans.select("clip_id", "track_id", (F.col("track_id") % 3).cast("string").alias("number")), spans


@query("merged_tracks", sql("+" + _MERGE + " SELECT clip_id, track_id, canonical_id FROM rm", "boxes", recursive=True))
def merged_tracks(spark, sf):
    return identity.merge_by_number(*_merge_inputs(spark, sf))


@query("remapped_spans", sql("+" + _MERGE + ' SELECT clip_id, canonical_id AS track_id, min(s) AS start, max(e) AS "end", min(ord) AS ord FROM sh JOIN rm USING (clip_id, track_id) GROUP BY 1, 2', "boxes", recursive=True))
def remapped_spans(spark, sf):
    named, spans = _merge_inputs(spark, sf)
    return identity.remapped_spans(spans, identity.merge_by_number(named, spans))


@query(
    "identity_telemetry",
    sql(
        "+" + _CONFIRM + """, v AS (SELECT clip_id, track_id, count(*) AS v FROM m GROUP BY ALL),
        vs AS (SELECT clip_id, count(*) AS tracks_with_any_read, max(v) AS max_votes, median(v) AS median_votes FROM v GROUP BY ALL),
        t AS (SELECT clip_id, count(DISTINCT track_id) AS tracks FROM boxes GROUP BY ALL), i AS (SELECT clip_id, count(DISTINCT track_id) AS n FROM cf GROUP BY ALL),
        du AS (SELECT clip_id, count(*) AS d FROM (SELECT clip_id, number FROM cf GROUP BY ALL HAVING count(DISTINCT track_id) > 1) GROUP BY ALL),
        h AS (SELECT clip_id, string_agg(number || '=' || n, ',' ORDER BY n DESC, number) AS read_histogram FROM (SELECT clip_id, number, count(*) AS n FROM reads GROUP BY ALL) GROUP BY ALL)
        SELECT t.clip_id, tracks AS tracks_after_stitch, tracks AS tracks_after_merge, coalesce(i.n, 0) AS tracks_identified, coalesce(tracks_with_any_read, 0) AS tracks_with_any_read,
          coalesce(max_votes, 0) AS max_votes, coalesce(median_votes, 0) AS median_votes, read_histogram, coalesce(du.d, 0) AS duplicated_numbers, round(coalesce(i.n, 0) / greatest(tracks, 1), 4) AS read_rate
        FROM t LEFT JOIN i USING (clip_id) LEFT JOIN vs USING (clip_id) LEFT JOIN h USING (clip_id) LEFT JOIN du USING (clip_id)""",
        "boxes", "reads",
    ),
)
def identity_telemetry(spark, sf):
    b, v = a.boxes(spark, sf), _votes(spark, sf)
    return r4(identity.telemetry(a.reads(spark, sf), v, identity.confirm_numbers(v, min_share=0.3), identity.spans_of(b), b), "read_rate")


@query("without_abstentions", sql("SELECT clip_id, frame, read_id, number FROM reads WHERE number <> '7'", "reads"))
def without_abstentions(spark, sf):
    return identity.without_abstentions(a.reads(spark, sf), "7").select("clip_id", "frame", "read_id", "number")


@query(
    "numberless_players",
    sql("SELECT clip_id, frame, track_id, ord FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM reads r WHERE r.clip_id = b.clip_id AND r.frame = b.frame AND (r.x1 + r.x2) / 2 BETWEEN b.x1 AND b.x2 AND (r.y1 + r.y2) / 2 BETWEEN b.y1 AND b.y2)", "boxes", "reads"),
)
def numberless_players(spark, sf):
    return identity.mined_abstentions(a.boxes(spark, sf), a.reads(spark, sf), 2**31 - 1, 0).select("clip_id", "frame", "track_id", "ord")


@query("players_with_numbers", sql("+" + _CONFIRM + " SELECT t.clip_id, t.track_id, cf.number FROM (SELECT DISTINCT clip_id, track_id FROM boxes) t LEFT JOIN cf USING (clip_id, track_id)", "boxes", "reads"))
def players_with_numbers(spark, sf):
    t = a.boxes(spark, sf).select("clip_id", "track_id").distinct()
    return t.join(_confirmed(spark, sf).select("clip_id", "track_id", "number"), ["clip_id", "track_id"], "left")


# --- ball and shots -------------------------------------------------------------------------------------------------

_FILL = """fl AS (SELECT *, max(CASE WHEN bx IS NOT NULL THEN i END) OVER w0 AS pi, min(CASE WHEN bx IS NOT NULL THEN i END) OVER w1 AS ni FROM ball
  WINDOW w0 AS (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY clip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fd AS (SELECT f.clip_id, f.i, coalesce(f.bx, CASE WHEN f.ni - f.pi - 1 <= 2 THEN p.bx + (f.i - f.pi) / (f.ni - f.pi) * (n.bx - p.bx) END) AS bx,
  coalesce(f.by_, CASE WHEN f.ni - f.pi - 1 <= 2 THEN p.by_ + (f.i - f.pi) / (f.ni - f.pi) * (n.by_ - p.by_) END) AS by_
  FROM fl f LEFT JOIN ball p ON p.clip_id = f.clip_id AND p.i = f.pi LEFT JOIN ball n ON n.clip_id = f.clip_id AND n.i = f.ni)"""


@query("gap_fill", sql("+" + _FILL + " SELECT clip_id, i, round(bx, 4) AS bx, round(by_, 4) AS by_ FROM fd", "ball"))
def gap_fill(spark, sf):
    return r4(shots.fill_gaps(a.ball(spark, sf), 2), "bx", "by_").select("clip_id", "i", "bx", "by_")


_CX, _CY, _REACH = (RIM[0] + RIM[2]) / 2, (RIM[1] + RIM[3]) / 2, 1.8 * max(RIM[2] - RIM[0], 1.0)
_NEAR = f"(abs(d.bx - {_CX}e0) <= {_REACH}e0)"
_MADE = f"(coalesce(s.py <= {_CY}e0 AND {_CY}e0 < d.by_, FALSE) AND d.bx BETWEEN {RIM[0]} AND {RIM[2]})"
_OVER = f"({_MADE} OR d.i - s.op > {CFG.timeout} OR (NOT {_NEAR} AND d.by_ > {_CY}e0))"
_OPENS = f"(s.op < 0 AND {_NEAR} AND d.by_ < {RIM[1]}e0 AND d.i >= s.cool)"
_SHOTS = (
    _FILL
    + f""", cv AS (SELECT clip_id, count(*) AS n, avg(CASE WHEN bx IS NOT NULL THEN 1 ELSE 0 END) AS coverage FROM fd GROUP BY clip_id),
s AS (SELECT clip_id, -1 AS i, -1 AS op, 0e0 AS sx, 0e0 AS sy, -1 AS cool, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS INTEGER) AS ef, CAST(NULL AS VARCHAR) AS eo, 0e0 AS ex, 0e0 AS ey FROM cv WHERE coverage >= {CFG.min_coverage}
  UNION ALL SELECT s.clip_id, d.i,
    CASE WHEN d.bx IS NULL THEN s.op WHEN {_OPENS} THEN d.i WHEN s.op >= 0 AND {_OVER} THEN -1 ELSE s.op END,
    CASE WHEN d.bx IS NOT NULL AND {_OPENS} THEN d.bx ELSE s.sx END, CASE WHEN d.bx IS NOT NULL AND {_OPENS} THEN d.by_ ELSE s.sy END,
    CASE WHEN d.bx IS NOT NULL AND s.op >= 0 AND {_OVER} THEN d.i + {CFG.cooldown} ELSE s.cool END, d.by_,
    CASE WHEN d.bx IS NOT NULL AND s.op >= 0 AND {_OVER} THEN s.op END, CASE WHEN d.bx IS NOT NULL AND s.op >= 0 AND {_OVER} THEN CASE WHEN {_MADE} THEN 'made' ELSE 'missed' END END, s.sx, s.sy
  FROM s JOIN fd d ON d.clip_id = s.clip_id AND d.i = s.i + 1),
ev2 AS (SELECT clip_id, ef AS frame, eo AS outcome, ex AS ball_x, ey AS ball_y, i AS resolved_frame FROM s WHERE ef IS NOT NULL
  UNION ALL SELECT s.clip_id, op, 'missed', sx, sy, i FROM s JOIN cv ON cv.clip_id = s.clip_id AND s.i = cv.n - 1 WHERE op >= 0)"""
)


def _found(spark, sf):
    return shots.detect_shots(a.ball(spark, sf), a.rims(spark, sf), CFG)


@query("shot_events", sql("+" + _SHOTS + " SELECT clip_id, CAST(frame AS INTEGER) AS frame, round(frame / 30e0, 4) AS time_s, outcome, round(ball_x, 4) AS ball_x, round(ball_y, 4) AS ball_y, CAST(resolved_frame AS INTEGER) AS resolved_frame FROM ev2", "ball", recursive=True))
def shot_events(spark, sf):
    return r4(shots.shot_events(_found(spark, sf), F.lit(30.0)), "time_s", "ball_x", "ball_y")


@query("shot_summary", sql("+" + _SHOTS + f", c AS (SELECT clip_id, count(*) AS n_events FROM ev2 GROUP BY clip_id) SELECT cv.clip_id, n, round(coverage, 4) AS coverage, coverage >= {CFG.min_coverage} AS available, coalesce(n_events, 0) AS n_events FROM cv LEFT JOIN c USING (clip_id)", "ball", recursive=True))
def shot_summary(spark, sf):
    return r4(_found(spark, sf), "coverage").select("clip_id", "n", "coverage", "available", F.size("events").cast("long").alias("n_events"))


@query("rim_box", sql("SELECT clip_id, CASE WHEN count(*) >= 5 THEN median(x1) END AS x1, CASE WHEN count(*) >= 5 THEN median(y2) END AS y2 FROM daily GROUP BY clip_id", "daily"))
def rim_box(spark, sf):
    return shots.rim_box(a.daily(spark, sf)).select("clip_id", F.col("rim.x1").alias("x1"), F.col("rim.y2").alias("y2"))


@query("best_detection", sql("+ x AS (SELECT *, CAST(det_ord % 3 AS VARCHAR) AS class_name, row_number() OVER (PARTITION BY image_id, det_ord % 3 ORDER BY score DESC, det_ord) AS r FROM dets) SELECT image_id, class_name, det_ord FROM x WHERE r = 1", "dets"))
def best_detection(spark, sf):
    d = a.detections(spark, sf).select("image_id", (F.col("det_ord") % 3).cast("string").alias("class_name"), F.col("score").alias("conf"), F.col("det_ord").alias("ord"))
    return shots.best_detection(d, ["image_id"]).select("image_id", "class_name", F.col("ord").alias("det_ord"))


@query(
    "shooters",
    sql(
        """+ sh AS (SELECT clip_id, frame, read_id, x1 AS ball_x, y1 AS ball_y FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY read_id) AS r FROM reads) WHERE r = 1),
        d AS (SELECT s.clip_id, s.frame, b.track_id, row_number() OVER (PARTITION BY s.clip_id, s.frame ORDER BY sqrt(power((b.x1 + b.x2) / 2 - ball_x, 2) + power((b.y1 + b.y2) / 2 - ball_y, 2)), b.ord) AS r
          FROM sh s JOIN boxes b ON b.clip_id = s.clip_id AND b.frame = s.frame WHERE sqrt(power((b.x1 + b.x2) / 2 - ball_x, 2) + power((b.y1 + b.y2) / 2 - ball_y, 2)) < 15)
        SELECT s.clip_id, s.frame, s.read_id, d.track_id AS shooter_track_id FROM sh s LEFT JOIN d ON d.clip_id = s.clip_id AND d.frame = s.frame AND d.r = 1""",
        "boxes", "reads",
    ),
)
def shooters(spark, sf):
    w = Window.partitionBy("clip_id", "frame").orderBy("read_id")
    s = a.reads(spark, sf).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    s = s.select("clip_id", "frame", "read_id", F.col("box.x1").alias("ball_x"), F.col("box.y1").alias("ball_y"))
    return shots.shooters(s, a.boxes(spark, sf), 15.0).select("clip_id", "frame", "read_id", "shooter_track_id")


TOL = 40000.0
_SHOTMATCH = f"""cd AS (SELECT e.clip_id, e.event_ord, e.time_s, list({{'d': abs(e.time_s - t.time_s), 't': t.truth_ord}} ORDER BY abs(e.time_s - t.time_s), t.truth_ord) AS c
  FROM shots e JOIN facts t ON t.clip_id = e.clip_id AND abs(e.time_s - t.time_s) <= {TOL} GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY time_s, event_ord) AS j FROM cd),
f AS (SELECT clip_id, 0 AS j, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS event_ord, CAST(NULL AS BIGINT) AS truth_ord FROM (SELECT DISTINCT clip_id FROM o)
  UNION ALL SELECT f.clip_id, o.j, CASE WHEN len(list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))) > 0 THEN list_append(f.used, list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))[1].t) ELSE f.used END,
    o.event_ord, list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))[1].t FROM f JOIN o ON o.clip_id = f.clip_id AND o.j = f.j + 1),
pr AS (SELECT clip_id, event_ord, truth_ord FROM f WHERE truth_ord IS NOT NULL),
mt AS (SELECT * FROM pr UNION ALL SELECT clip_id, event_ord, NULL FROM shots WHERE event_ord NOT IN (SELECT event_ord FROM pr)
  UNION ALL SELECT clip_id, NULL, truth_ord FROM facts WHERE truth_ord NOT IN (SELECT truth_ord FROM pr))"""


def _matches(spark, sf):
    e, t = a.timed(spark, sf, "purchase", "event_ord"), a.timed(spark, sf, "click", "truth_ord")
    return shots.match_events(e, t, TOL), e, t


@query("shot_matches", sql("+" + _SHOTMATCH + " SELECT clip_id, event_ord, truth_ord FROM mt", "shots", "facts", recursive=True))
def shot_matches(spark, sf):
    return _matches(spark, sf)[0]


@query(
    "shot_scores",
    sql(
        "+" + _SHOTMATCH + """, z AS (SELECT count(*) FILTER (WHERE m.event_ord IS NOT NULL AND m.truth_ord IS NOT NULL) AS tp, count(*) FILTER (WHERE m.truth_ord IS NULL) AS fp,
        count(*) FILTER (WHERE m.event_ord IS NULL) AS fn, count(*) FILTER (WHERE e.outcome = t.outcome) AS outcomes_ok FROM mt m LEFT JOIN shots e ON e.event_ord = m.event_ord LEFT JOIN facts t ON t.truth_ord = m.truth_ord)
        SELECT tp, fp, fn, outcomes_ok, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
        round(coalesce(outcomes_ok / nullif(tp, 0), 0), 4) AS outcome_accuracy FROM z""",
        "shots", "facts", recursive=True,
    ),
)
def shot_scores(spark, sf):
    return r4(shots.shot_scores(*_matches(spark, sf)), "precision", "recall", "outcome_accuracy")


# --- tracklets ------------------------------------------------------------------------------------------------------

_LIFE = """lf AS (SELECT clip_id, track_id, min(i) AS born, max(i) AS died, count(*) AS hits, arg_min((x1 + x2) / 2, i) AS bx, arg_min((y1 + y2) / 2, i) AS by_,
  arg_max((x1 + x2) / 2, i) AS dx, arg_max((y1 + y2) / 2, i) AS dy FROM daily GROUP BY ALL)"""


@query("tracklets", sql("+" + _LIFE + " SELECT clip_id, track_id, born AS start_frame, died AS end_frame, round(bx, 4) AS sx, round(by_, 4) AS sy, round(dx, 4) AS ex, round(dy, 4) AS ey FROM lf", "daily"))
def tracklets(spark, sf):
    t = stitch.tracklets(a.daily(spark, sf))
    t = t.select("clip_id", "track_id", "start_frame", "end_frame", F.col("start_xy.x").alias("sx"), F.col("start_xy.y").alias("sy"), F.col("end_xy.x").alias("ex"), F.col("end_xy.y").alias("ey"))
    return r4(t, "sx", "sy", "ex", "ey")


@query("similarity", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT p.vec_id AS left_id, q.vec_id AS right_id, round(list_dot_product(p.v, q.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v))), 4) AS cosine FROM e p JOIN e q ON q.vec_id = p.vec_id + 1")
def similarity(spark, sf):
    e = a.table(spark, sf, "embeddings")
    p, q = e.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("p")), e.select(F.col("vec_id").alias("right_id"), (F.col("vec_id") - 1).alias("left_id"), F.col("embedding").alias("q"))
    return p.join(q, "left_id").select("left_id", "right_id", F.round(g.cosine(F.col("p"), F.col("q")), 4).alias("cosine"))


def _short(spark, sf):
    """Tracklets cut to a few frames so that gaps between them exist."""
    t = stitch.tracklets(a.daily(spark, sf), a.features(spark, sf))
    start = (F.col("track_id") * 7) % 300
    return t.withColumns({"start_frame": start, "end_frame": start + 5 + F.col("track_id") % 11})


# A clip's tracklets are dealt in order to a list of groups; pick is the group that the tracklet of that step joins.
_LIKE = "CASE WHEN len(q.f) = len(t.f) AND list_dot_product(q.f, q.f) > 0 AND list_dot_product(t.f, t.f) > 0 THEN list_dot_product(q.f, t.f) / sqrt(list_dot_product(q.f, q.f) * list_dot_product(t.f, t.f)) ELSE 0e0 END"
_APART = "sqrt((t.sx - q.x) ** 2 + (t.sy - q.y) ** 2)"
_DIM = "SELECT clip_id, track_id, p, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT clip_id, track_id, unnest(feature) AS v, unnest(range(len(feature))) AS p FROM feats) GROUP BY ALL"


def _stitched(gate: str, score: str) -> str:
    """SQL of the greedy linking: gate and score of a group q and the tracklet t, g frames apart."""
    g_ = "(t.s - q.e)"
    one = f"CASE WHEN {gate} THEN {score} END".replace("$gap", g_).replace("$apart", _APART).replace("$like", _LIKE)
    new = "'e': t.e, 'x': t.ex, 'y': t.ey, 'h': t.eh"
    return sql(
        f"""+ dims AS ({_DIM}), mean AS (SELECT clip_id, track_id, list(v ORDER BY p) AS f FROM dims GROUP BY ALL),
        lf AS (SELECT clip_id, track_id, min(ord) AS ord, (track_id * 7) % 300 AS s, (track_id * 7) % 300 + 5 + track_id % 11 AS e,
          arg_min((x1 + x2) / 2, i) AS sx, arg_min((y1 + y2) / 2, i) AS sy, arg_max((x1 + x2) / 2, i) AS ex, arg_max((y1 + y2) / 2, i) AS ey,
          arg_min(y2 - y1, i) AS sh, arg_max(y2 - y1, i) AS eh FROM daily GROUP BY ALL),
        t AS (SELECT lf.*, coalesce(f, [0e0]) AS f, row_number() OVER (PARTITION BY lf.clip_id ORDER BY s, ord) AS k FROM lf LEFT JOIN mean USING (clip_id, track_id)),
        st AS (SELECT clip_id, track_id, k, [{{'f': t.f, {new}}}] AS gs, 1 AS pick FROM t WHERE k = 1 UNION ALL
          SELECT clip_id, track_id, k, CASE WHEN best IS NULL THEN list_append(gs, {{'f': f, 'e': e, 'x': ex, 'y': ey, 'h': eh}})
              ELSE list_transform(gs, lambda q, j: CASE WHEN j = best THEN {{'f': q.f, 'e': e, 'x': ex, 'y': ey, 'h': eh}} ELSE q END) END,
            CAST(coalesce(best, len(gs) + 1) AS INTEGER)
          FROM (SELECT *, CASE WHEN list_max(sc) IS NOT NULL THEN list_position(sc, list_max(sc)) END AS best
            FROM (SELECT t.*, st.gs, list_transform(st.gs, lambda q: {one}) AS sc FROM st JOIN t ON t.clip_id = st.clip_id AND t.k = st.k + 1)))
        SELECT clip_id, track_id, min(track_id) OVER (PARTITION BY clip_id, pick) AS canonical_id FROM st""",
        "daily", "feats", recursive=True,
    )


@query(
    "stitched_court",
    _stitched(
        "$gap > 0 AND $gap / 10e0 <= 1.5e0 AND $apart <= 15 + 25 * $gap / 10e0 AND $like >= -1",
        "$like - 0.5e0 * $apart / (15 + 25 * $gap / 10e0) - 0.5e0 * $gap / 10e0 / 1.5e0",
    ),
)
def stitched_court(spark, sf):
    return stitch.link(_short(spark, sf), stitch.CourtRule(fps=10.0, least_similarity=-1.0, base_ft=15.0))


@query(
    "stitched_pixels",
    _stitched(
        "$gap > 0 AND $gap <= 20 AND q.h + t.sh > 0 AND $apart <= 2.5e0 * (q.h + t.sh) / 2 AND $like >= -1",
        "$like - 0.5e0 * $apart / (2.5e0 * (q.h + t.sh) / 2) - 0.5e0 * $gap / 20e0",
    ),
)
def stitched_pixels(spark, sf):
    return stitch.link(_short(spark, sf), stitch.PixelRule(max_gap=20, least_similarity=-1.0))


@query("team_votes", sql("SELECT clip_id, track_id, CAST(CASE WHEN avg(CASE WHEN x > 47 THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS team FROM pos GROUP BY ALL", "pos"))
def team_votes(spark, sf):
    return teams.team_votes(a.positions(spark, sf).withColumn("label", (F.col("x") > 47).cast("int")))


@query("team_clusters")
def team_clusters(spark, sf):
    e = a.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("lab")])
    return teams.cluster_labels(e, ["l", "a", "b"]).select("vec_id", "label")


# --- tracking health ------------------------------------------------------------------------------------------------

_FRAMES = "fr AS (SELECT clip_id, CAST(max(i) + 1 AS BIGINT) AS n_frames FROM daily GROUP BY clip_id)"
_SWITCH = f"""{_LIFE}, {_FRAMES}, dd AS (SELECT lf.* FROM lf JOIN fr USING (clip_id) WHERE died < n_frames - 1),
sw AS (SELECT clip_id, count(*) AS n FROM dd WHERE EXISTS (SELECT 1 FROM lf b WHERE b.clip_id = dd.clip_id AND b.track_id <> dd.track_id AND b.born - dd.died BETWEEN 1 AND 5
  AND power(b.bx - dd.dx, 2) + power(b.by_ - dd.dy, 2) <= 900) GROUP BY clip_id)"""


def _frames(spark, sf):
    return a.daily(spark, sf).groupBy("clip_id").agg((F.max("i") + 1).cast("long").alias("n_frames"))


@query("switch_proxy", sql("+" + _SWITCH + " SELECT clip_id, coalesce(n, 0) AS id_switch_proxy FROM fr LEFT JOIN sw USING (clip_id)", "daily"))
def switch_proxy(spark, sf):
    return diagnose.switches(diagnose.life(a.daily(spark, sf)), _frames(spark, sf), 5, 30.0)


@query(
    "track_health",
    sql(
        "+" + _SWITCH + """, rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY hits, track_id) - 1 AS r, count(*) OVER (PARTITION BY clip_id) AS m FROM lf),
        pt AS (SELECT clip_id, CAST(sum(hits) AS BIGINT) AS total_boxes, count(*) AS unique_ids, avg(hits) AS mean_len, median(hits) AS med_len, max(CASE WHEN r = floor(0.9e0 * (m - 1)) THEN hits END) AS p90, count(*) FILTER (WHERE born > 3) AS fresh FROM rk GROUP BY clip_id),
        al AS (SELECT clip_id, unnest(range(n_frames)) AS i FROM fr), ct AS (SELECT al.clip_id, al.i, count(d.track_id) AS c FROM al LEFT JOIN daily d ON d.clip_id = al.clip_id AND d.i = al.i GROUP BY ALL),
        md AS (SELECT clip_id, median(c) AS med FROM ct GROUP BY clip_id)
        SELECT clip_id, n_frames, med AS median_simultaneous, total_boxes, unique_ids, round(mean_len, 4) AS track_len_mean, med_len AS track_len_median, p90 AS track_len_p90, fresh AS new_ids_after_warmup,
          coalesce(sw.n, 0) AS id_switch_proxy, round(coalesce(unique_ids / nullif(med, 0), 0), 4) AS fragmentation_ratio, round(med_len / 3e0, 4) AS track_len_median_s
        FROM fr JOIN pt USING (clip_id) JOIN md USING (clip_id) LEFT JOIN sw USING (clip_id)""",
        "daily",
    ),
)
def track_health(spark, sf):
    out = diagnose.diagnose(a.daily(spark, sf), _frames(spark, sf), 3.0, gap=5, reach=30.0)
    return r4(out, "track_len_mean", "fragmentation_ratio", "track_len_median_s")


# --- geometry -------------------------------------------------------------------------------------------------------

_QX, _QY, _ = _projected("value", "k")


@query("projected_points", sql(f"SELECT event_id, round({_QX}, 4) AS x, round({_QY}, 4) AS y FROM ev"))
def projected_points(spark, sf):
    e = a.events(spark, sf)
    p = g.project(a.matrix(), F.col("value"), F.col("k").cast("double"))
    return e.select("event_id", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


@query("round_trip", sql("SELECT event_id, round(value, 4) AS x, round(CAST(k AS DOUBLE), 4) AS y FROM ev"))
def round_trip(spark, sf):
    """Projecting and projecting back gives the point again."""
    e = a.events(spark, sf).withColumn("p", g.project(a.matrix(), F.col("value"), F.col("k").cast("double")))
    q = g.project(g.inverse(a.matrix()), F.col("p.x"), F.col("p.y"))
    return e.select("event_id", F.round(q["x"], 4).alias("x"), F.round(q["y"], 4).alias("y"))


_FULL = ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in sorted(courts.full_court().items()))


@query("reprojection", sql(f"+ tp(kp, fx, fy) AS (VALUES {_FULL}), er AS (SELECT kp, sqrt(power({_QX} - fx, 2) + power({_QY} - fy, 2)) AS e FROM ev JOIN tp ON tp.kp = ev.event_id % 33) SELECT kp, round(avg(e), 4) AS mean_err, round(median(e), 4) AS median_err, round(quantile_cont(e, 0.9), 4) AS p90_err, round(quantile_cont(e, 0.99), 4) AS p99_err, count(*) AS n FROM er GROUP BY kp", "ev"))
def reprojection(spark, sf):
    e = a.events(spark, sf).select((F.col("event_id") % 33).cast("int").alias("kp"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    e = e.join(F.broadcast(courts.full_table(spark)), "kp")
    return r4(registration.error_summary(registration.reprojection(e, a.matrix()), ["kp"]), "mean_err", "median_err", "p90_err", "p99_err")


@query("box_overlaps", sql("SELECT a.clip_id, a.frame, a.ord AS left_ord, b.ord AS right_ord, round(greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (400 + 400 - greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) + 1e-9), 4) AS iou FROM boxes a JOIN boxes b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.track_id = b.track_id AND a.ord < b.ord", "boxes"))
def box_overlaps(spark, sf):
    b = a.boxes(spark, sf)
    p, q = b.select("clip_id", "frame", "track_id", F.col("ord").alias("left_ord"), F.col("box").alias("p")), b.select("clip_id", "frame", "track_id", F.col("ord").alias("right_ord"), F.col("box").alias("q"))
    return p.join(q, ["clip_id", "frame", "track_id"]).filter("left_ord < right_ord").select("clip_id", "frame", "left_ord", "right_ord", F.round(g.iou(F.col("p"), F.col("q")), 4).alias("iou"))


AFFINE = [0.9, 0.1, 3.0, -0.2, 1.1, -2.0]


@query("warped_boxes", sql(f"+ c AS (SELECT ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, sqrt(abs({AFFINE[0]}e0 * {AFFINE[4]}e0 - {AFFINE[1]}e0 * ({AFFINE[3]}e0))) * 10 AS h FROM boxes) SELECT ord, round({AFFINE[0]}e0 * cx + {AFFINE[1]}e0 * cy + {AFFINE[2]} - h, 4) AS x1, round(({AFFINE[3]}e0) * cx + {AFFINE[4]}e0 * cy + ({AFFINE[5]}) + h, 4) AS y2 FROM c", "boxes"))
def warped_boxes(spark, sf):
    w = g.warp_box(F.col("box"), F.array(*[F.lit(v) for v in AFFINE]))
    return a.boxes(spark, sf).select("ord", F.round(w["x1"], 4).alias("x1"), F.round(w["y2"], 4).alias("y2"))


@query("torso_boxes", sql("SELECT ord, CAST(trunc(x1 + 0.2e0 * (x2 - x1)) AS INTEGER) AS x1, CAST(trunc(y1 + 0.55e0 * (y2 - y1)) AS INTEGER) AS y2 FROM boxes", "boxes"))
def torso_boxes(spark, sf):
    t = g.torso(F.col("box"), F.lit(1920), F.lit(1080))
    return a.boxes(spark, sf).select("ord", t["x1"].alias("x1"), t["y2"].alias("y2"))


@query("box_lookup", sql("+ q AS (SELECT r.read_id, b.ord, row_number() OVER (PARTITION BY r.read_id ORDER BY (b.x2 - b.x1) * (b.y2 - b.y1), b.ord) AS rn FROM reads r JOIN boxes b ON b.clip_id = r.clip_id AND b.frame = r.frame AND r.x1 BETWEEN b.x1 AND b.x2 AND r.y1 BETWEEN b.y1 AND b.y2) SELECT r.read_id, q.ord FROM reads r LEFT JOIN q ON q.read_id = r.read_id AND q.rn = 1", "boxes", "reads"))
def box_lookup(spark, sf):
    # whole pixels of area, so that equal boxes tie in both engines
    b = a.boxes(spark, sf).withColumn("box", g.box(F.col("box.x1"), F.col("box.y1"), F.col("box.x1") + 20, F.col("box.y1") + 20))
    p = a.reads(spark, sf).select("clip_id", "frame", "read_id", F.col("box.x1").alias("px"), F.col("box.y1").alias("py"))
    return labels.box_at(b, p, ["clip_id", "frame"]).select("read_id", "ord")


@query("template_gaps", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {round(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5, 4)}e0)" for i, (p, q) in enumerate(zip([v for _, v in sorted(courts.full_court().items())], [v for _, v in sorted(courts.vendor_court().items())], strict=True))) + ") t(kp, gap_ft)")
def template_gaps(spark, sf):
    return r4(registration.template_gaps(spark), "gap_ft")


# --- evaluation -----------------------------------------------------------------------------------------------------

_IOU = "greatest(0e0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0e0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) / (800 - greatest(0e0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0e0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) + 1e-9)"
_AP = f"""cd AS (SELECT d.image_id, d.det_ord, d.score, list({{'i': {_IOU}, 't': t.truth_ord}}) AS c FROM dets d JOIN gts t ON t.image_id = d.image_id AND {_IOU} >= 0.5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_ord) AS j FROM cd),
f AS (SELECT image_id, 0 AS j, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_ord, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT image_id FROM o)
  UNION ALL SELECT f.image_id, o.j, CASE WHEN len(list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))) > 0 THEN list_append(f.used, list_max(list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))).t) ELSE f.used END,
    o.det_ord, list_max(list_filter(o.c, lambda q: NOT list_contains(f.used, q.t))).t FROM f JOIN o ON o.image_id = f.image_id AND o.j = f.j + 1),
mt AS (SELECT d.image_id, d.det_ord, d.score, f.hit FROM dets d LEFT JOIN f ON f.det_ord = d.det_ord AND f.hit IS NOT NULL)"""


@query("detection_matches", sql("+" + _AP + " SELECT image_id, det_ord, hit FROM mt", "dets", "gts", recursive=True))
def detection_matches(spark, sf):
    return evaluation.match_detections(a.detections(spark, sf), a.truths(spark, sf)).select("image_id", "det_ord", "hit")


@query(
    "average_precision",
    sql(
        "+" + _AP + """, rk AS (SELECT *, sum(CASE WHEN hit IS NOT NULL THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS k FROM mt WINDOW w AS (ORDER BY score DESC, image_id, det_ord ROWS UNBOUNDED PRECEDING)),
        pr AS (SELECT k, tp / (SELECT count(*) FROM gts) AS recall, max(tp / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM rk),
        sg AS (SELECT (recall - lag(recall, 1, 0) OVER (ORDER BY k)) * (p + coalesce(lag(p) OVER (ORDER BY k), p)) / 2 AS area FROM pr)
        SELECT round(coalesce(sum(area), 0), 4) AS average_precision FROM sg""",
        "dets", "gts", recursive=True,
    ),
)
def average_precision(spark, sf):
    t = a.truths(spark, sf)
    return r4(evaluation.average_precision(evaluation.match_detections(a.detections(spark, sf), t), t), "average_precision")


def _mot_sides(spark, sf):
    b = a.daily(spark, sf).select("clip_id", F.col("i").alias("frame"), F.col("track_id").alias("id"), F.col("box.x1").alias("x"), F.col("box.y1").alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), "ord")
    # the tracker misses what is at the left edge and is off by up to four feet elsewhere
    pred = b.filter(F.col("x") > 8).withColumns({"x": F.col("x") + F.col("ord") % 5, "id": F.when(F.col("frame") > 200, F.col("id") + 1000).otherwise(F.col("id"))})
    return b, pred


@query("mot_metrics")
def mot_metrics(spark, sf):
    return evaluation.mot_metrics(*_mot_sides(spark, sf))


@query("classifier_tiers", sql("SELECT avg(CASE WHEN k % 10 <> 9 AND event_type = 'view' THEN CASE WHEN k % 3 = 0 THEN 1e0 ELSE 0e0 END END) AS clean_accuracy, avg(CASE WHEN k % 10 <> 9 AND event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 1e0 ELSE 0e0 END END) AS degraded_accuracy, avg(CASE WHEN k % 10 = 9 THEN CASE WHEN k % 3 = 0 THEN 1e0 ELSE 0e0 END END) AS abstain_recall FROM ev").replace(" AS clean_accuracy", " AS ca").replace(" AS degraded_accuracy", " AS da").replace(" AS abstain_recall", " AS ar").replace("SELECT avg(CASE WHEN k % 10 <> 9 AND event_type = 'view'", "SELECT round(ca, 4) AS clean_accuracy, round(da, 4) AS degraded_accuracy, round(ar, 4) AS abstain_recall FROM (SELECT avg(CASE WHEN k % 10 <> 9 AND event_type = 'view'") + ")")
def classifier_tiers(spark, sf):
    e = a.events(spark, sf)
    label = F.when(F.col("k") % 10 == 9, "unreadable").otherwise((F.col("k") % 10).cast("string"))
    tier = F.when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "click", "degraded")
    p = e.select(label.alias("label"), F.when(F.col("k") % 3 == 0, label).otherwise("x").alias("predicted"), tier.alias("tier"))
    return r4(evaluation.classifier_tiers(p), "clean_accuracy", "degraded_accuracy", "abstain_recall")


@query("label_profile", sql("+ p AS (SELECT nullif(CAST(k % 12 AS VARCHAR), '0') AS l, count(*) AS n FROM ev GROUP BY 1) SELECT count(*) FILTER (WHERE l IS NOT NULL) AS classes, CAST(sum(n) AS BIGINT) AS \"rows\", CAST(coalesce(sum(n) FILTER (WHERE l IS NULL), 0) AS BIGINT) AS empty, min(n) FILTER (WHERE l IS NOT NULL) AS smallest, count(*) FILTER (WHERE l IS NOT NULL AND n < 5) AS rare, (SELECT string_agg(l, ',' ORDER BY n DESC, l) FROM (SELECT * FROM p WHERE l IS NOT NULL ORDER BY n DESC, l LIMIT 5)) AS top FROM p", "ev"))
def label_profile(spark, sf):
    return labels.label_profile(a.events(spark, sf).select(F.coalesce(F.nullif((F.col("k") % 12).cast("string"), F.lit("0")), F.lit("")).alias("label")))


@query("box_sizes", sql("SELECT CAST(track_id % 3 AS VARCHAR) AS class_name, count(*) AS n, round(median(x2 - x1), 4) AS median_w, round(median(y2 - y1), 4) AS median_h FROM boxes GROUP BY 1", "boxes"))
def box_sizes(spark, sf):
    return r4(labels.box_sizes(a.boxes(spark, sf).withColumn("class_name", (F.col("track_id") % 3).cast("string"))), "median_w", "median_h")


# --- registration ---------------------------------------------------------------------------------------------------


def _keypoints(spark, sf):
    """Court points seen through the inverse of the query homography, one frame per clip and day."""
    f = a.events(spark, sf).select((F.col("user_id") % 8).cast("string").alias("clip_id"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("frame")).distinct()
    p = g.project(g.inverse(a.matrix()), F.col("fx"), F.col("fy"))
    k = f.crossJoin(F.broadcast(courts.full_table(spark)))  # 33 rows a frame
    k = k.filter(F.abs(F.col("fx") - F.pmod(F.col("frame") * 11, F.lit(94))) <= 32)  # what a panning camera sees
    return k.select("clip_id", "frame", "kp", p["x"].alias("x"), p["y"].alias("y"), F.lit(1.0).alias("conf")), f


@query("registered_frames")
def registered_frames(spark, sf):
    k, f = _keypoints(spark, sf)
    out = registration.registered(registration.usable_keypoints(k, 0.5, 4, ["clip_id", "frame"]), f)
    return out.select("clip_id", "frame", *[F.round(F.col("h")[i], 4).alias(f"h{i}") for i in (0, 4, 8)])


@query("registration_rate")
def registration_rate(spark, sf):
    k, f = _keypoints(spark, sf)
    return registration.registration_rate(registration.registered(k, f))


@query("motion", None)
def motion(spark, sf):
    m = a.ball(spark, sf).select("clip_id", F.col("i").cast("long").alias("frame"), F.when(F.col("bx").isNotNull(), F.array(F.lit(1.0), F.lit(0.0), F.col("bx") / 100, F.lit(0.0), F.lit(1.0), F.col("by_") / 100)).alias("affine"))
    out = registration.accumulated_motion(m)
    return out.select("clip_id", "frame", F.round(F.col("h")[2], 4).alias("dx"), F.round(F.col("h")[5], 4).alias("dy"))


ORACLE["motion"] = sql("SELECT clip_id, CAST(i AS BIGINT) AS frame, round(sum(coalesce(bx, 0) / 100) OVER w, 4) AS dx, round(sum(coalesce(by_, 0) / 100) OVER w, 4) AS dy FROM ball WINDOW w AS (PARTITION BY clip_id ORDER BY i ROWS UNBOUNDED PRECEDING)", "ball")


@query("ema", sql("+ s AS (SELECT clip_id, i, bx AS e FROM ball WHERE i = 0 UNION ALL SELECT b.clip_id, b.i, coalesce(2e0 / 3 * s.e + 1e0 / 3 * b.bx, b.bx, s.e) FROM s JOIN ball b ON b.clip_id = s.clip_id AND b.i = s.i + 1) SELECT clip_id, CAST(i AS BIGINT) AS frame, round(e, 4) AS e FROM s", "ball", recursive=True))
def ema(spark, sf):
    return r4(registration.ema(a.ball(spark, sf).select("clip_id", F.col("i").alias("frame"), F.col("bx").alias("v")), 1 / 3), "e")


@query("best_instance", sql("+ s AS (SELECT track_id, t, ord % 2 AS instance, sum(y) AS c FROM pos GROUP BY ALL), b AS (SELECT track_id, instance, sum(c) AS c FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, instance) AS n FROM b) SELECT track_id, instance FROM r WHERE n = 1", "pos"))
def best_instance(spark, sf):
    k = a.positions(spark, sf).select("track_id", (F.col("ord") % 2).alias("instance"), F.col("y").alias("conf"))
    return registration.best_instance(k, ["track_id"]).select("track_id", "instance").distinct()


@query("keypoint_boxes", sql("SELECT track_id, coalesce(min(x) FILTER (WHERE team = 0), 0) AS x, coalesce(min(y) FILTER (WHERE team = 0), 0) AS y, round(coalesce(max(x) FILTER (WHERE team = 0) - min(x) FILTER (WHERE team = 0), 0), 4) AS w, round(coalesce(max(y) FILTER (WHERE team = 0) - min(y) FILTER (WHERE team = 0), 0), 4) AS h, count(*) FILTER (WHERE team = 0) AS n_visible FROM pos GROUP BY track_id", "pos"))
def keypoint_boxes(spark, sf):
    k = a.positions(spark, sf).withColumn("v", F.when(F.col("team") == 0, 2).otherwise(0))
    return r4(registration.keypoint_boxes(k, ["track_id"]), "w", "h")


@query("visible_landmarks")
def visible_landmarks(spark, sf):
    f = a.events(spark, sf).select(F.col("user_id").alias("clip_id"), F.lit(1280).alias("width"), F.lit(720).alias("height")).distinct()
    out = registration.projected_keypoints(f, courts.half_table(spark, "ncaa"), a.matrix())
    return r4(registration.flipped_keypoints(out, "ncaa"), "x", "y").select("clip_id", "kp", "x", "y", "v")
