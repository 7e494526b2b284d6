"""Registered queries of readers, writers, label edits and further operators, each with its SQL.

File formats are checked by writing a table, reading it back and comparing it with the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import courts
from ..functions import geometry as g
from ..operators import heatmaps, identity, labels, paths, registration, segments
from ..sources import adapters as a
from ..sources import readers, writers
from ..sources.adapters import H, sql
from ..sources.folders import scratch_folder
from .catalogue import _CONFIRM, _MERGE, _STATS, _TOTALS, PATH_CAP, PATH_MIN, STAT_COLS, _found, _keypoints, _merge_inputs, _PX, _PY, _SHOTS, CFG, ORACLE, query, r4

# --- readers and writers --------------------------------------------------------------------------------------------


@query("mot_files", sql("SELECT CAST(clip_id AS INTEGER) AS clip_id, i + 1 AS frame, CAST(track_id AS INTEGER) AS id, floor(x1) AS x, y1 AS y, 20e0 AS w, 20e0 AS h, 1e0 AS conf FROM daily", "daily"))
def mot_files(spark, sf):
    path = scratch_folder(spark) + "/mot"
    x, y = F.floor("box.x1").cast("double"), F.col("box.y1")
    writers.write_mot(a.daily(spark, sf).withColumns({"box": g.box(x, y, x + 20, y + 20), "conf": F.lit(None).cast("double")}), path)
    return readers.mot(spark, path, folder="clip_id")


@query("mot_empty_frames", sql("SELECT clip_id, CAST(unnest(range(1, max(i) + 2)) AS INTEGER) AS frame FROM daily GROUP BY clip_id", "daily"))
def mot_empty_frames(spark, sf):
    return readers.mot_frames(a.daily(spark, sf).select("clip_id", (F.col("i") + 1).alias("frame")))


@query("shot_label_files", sql("SELECT CAST(frame AS DOUBLE) AS time_s, CASE WHEN ord % 2 = 0 THEN 'made' ELSE 'missed' END AS outcome FROM pos", "pos"))
def shot_label_files(spark, sf):
    path = scratch_folder(spark) + "/labels"
    made = F.when(F.col("ord") % 2 == 0, "made ").otherwise(" missed")
    a.positions(spark, sf).select(F.col("frame").cast("double").alias("time_s"), made.alias("outcome")).write.csv(path, header=True)
    return readers.shot_labels(spark, path).select("time_s", "outcome")


@query("calibration_file", "SELECT unnest(range(9)) AS i, unnest([" + ", ".join(f"{v}e0" for v in H) + "]) AS v")
def calibration_file(spark, sf):
    path = scratch_folder(spark) + "/calibration"
    corners = courts.paint_corners()
    writers.write_calibration(spark, H, corners, corners, path)
    return readers.calibration(spark, path).select(F.posexplode("homography").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "v")


_KP = "kp5 AS (SELECT track_id AS image_id, CAST(frame AS INTEGER) AS kp, x, y, CASE WHEN ord % 3 = 0 THEN 0 ELSE 2 END AS v FROM pos WHERE frame < 5)"


def _kp5(spark, sf):
    """Five points to an image: the feature of a court in a frame."""
    p = a.positions(spark, sf).filter("frame < 5")
    return p.select(F.col("track_id").alias("image_id"), F.col("frame").cast("int").alias("kp"), "x", "y", F.when(F.col("ord") % 3 == 0, 0).otherwise(2).alias("v"))


@query("coco_files", sql("+" + _KP + " SELECT image_id, 'im' || image_id || '.jpg' AS file_name, 100e0 AS width, 100e0 AS height, image_id + 7 AS ann_id, kp, x, y, v FROM kp5", "pos"))
def coco_files(spark, sf):
    path = scratch_folder(spark) + "/coco"
    trio = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "v"))), lambda p: F.array(p["x"], p["y"], p["v"].cast("double"))))
    per = _kp5(spark, sf).groupBy("image_id").agg(trio.alias("k"))
    image = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("im"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    note = F.struct((F.col("image_id") + 7).alias("id"), "image_id", F.lit(2).alias("category_id"), F.col("k").alias("keypoints"))
    other = F.struct((F.col("image_id") + 9).alias("id"), "image_id", F.lit(1).alias("category_id"), F.array().cast("array<double>").alias("keypoints"))
    kinds = F.array(F.struct(F.lit(1).alias("id"), F.lit("ball").alias("name"), F.array().cast("array<string>").alias("keypoints")), F.struct(F.lit(2).alias("id"), F.lit("court").alias("name"), F.array(F.lit("a")).alias("keypoints")))
    files = per.groupBy((F.col("image_id") % 4).alias("clip_id")).agg(F.collect_list(image).alias("images"), F.flatten(F.collect_list(F.array(note, other))).alias("annotations"))
    writers.write_texts(files.select("clip_id", F.to_json(F.struct("images", "annotations", kinds.alias("categories"))).alias("value")), path)
    return readers.coco_keypoints(spark, path)


@query("coco_annotations", sql("+" + _KP + " SELECT image_id, count(*) FILTER (WHERE v > 0) AS num_keypoints, coalesce(min(x) FILTER (WHERE v > 0), 0) AS x, round(coalesce(max(y) FILTER (WHERE v > 0) - min(y) FILTER (WHERE v > 0), 0), 4) AS h, count(*) * 3 AS n FROM kp5 GROUP BY image_id", "pos"))
def coco_annotations(spark, sf):
    out = writers.coco_records(_kp5(spark, sf)).select("image_id", F.from_json("value", "image_id long, keypoints array<double>, num_keypoints long, bbox array<double>").alias("r"))
    return out.select("image_id", "r.num_keypoints", F.col("r.bbox")[0].alias("x"), F.round(F.col("r.bbox")[3], 4).alias("h"), F.size("r.keypoints").cast("long").alias("n"))


@query("yolo_files", sql("+" + _KP + ", b AS (SELECT min(x) FILTER (WHERE v > 0) AS x1, max(x) FILTER (WHERE v > 0) AS x2, min(y) FILTER (WHERE v > 0) AS y1, max(y) FILTER (WHERE v > 0) AS y2 FROM kp5 GROUP BY image_id) SELECT round(coalesce((x1 + x2) / 256, 0), 4) AS cx, round(coalesce((y1 + y2) / 256, 0), 4) AS cy, round(coalesce((x2 - x1) / 128, 0), 4) AS w, round(coalesce((y2 - y1) / 128, 0), 4) AS h FROM b", "pos"))
def yolo_files(spark, sf):
    path, k = scratch_folder(spark) + "/yolo", _kp5(spark, sf)
    images = k.select("image_id").distinct().select("image_id", F.concat(F.lit("im"), "image_id").alias("file_name"), F.lit(128.0).alias("width"), F.lit(128.0).alias("height"))
    # in full digits, and rounded as SQL rounds, in binary: six digits would be rounded twice
    writers.yolo_pose_lines(images, k, digits=None).select("value").write.text(path)
    return readers.yolo_boxes(spark, path).select(*[(F.round(F.col(c) * 10000) / 10000).alias(c) for c in ("cx", "cy", "w", "h")])


@query("ocr_files", sql("SELECT 'crop' || event_id AS image, CASE WHEN k % 5 = 0 THEN 'unreadable' ELSE CAST(k AS VARCHAR) END AS label FROM ev"))
def ocr_files(spark, sf):
    path = scratch_folder(spark) + "/ocr"
    suffix = F.when(F.col("k") % 5 == 0, "").otherwise(F.col("k").cast("string"))
    a.events(spark, sf).select(F.concat(F.lit("crop"), "event_id").alias("image"), F.lit("number").alias("prefix"), suffix.alias("suffix")).write.json(path)
    return readers.ocr(spark, path)


@query("clip_durations", sql("SELECT clip_id, coalesce(nullif(clip_id % 3 * 10e0, 0), 30) AS fps, n AS frame_count, round(n / coalesce(nullif(clip_id % 3 * 10e0, 0), 30), 4) AS duration_s FROM (SELECT clip_id, count(*) AS n FROM pos GROUP BY clip_id)", "pos"))
def clip_durations(spark, sf):
    c = a.positions(spark, sf).groupBy("clip_id").agg(F.count(F.lit(1)).alias("frame_count")).withColumn("fps", (F.col("clip_id") % 3 * 10).cast("double"))
    return r4(readers.clip_info(c), "duration_s").select("clip_id", "fps", "frame_count", "duration_s")


@query("events_json", sql("+" + _SHOTS + f", c AS (SELECT clip_id, count(*) AS n_events, round(sum(frame), 4) AS frames FROM ev2 GROUP BY clip_id) SELECT cv.clip_id, round(coverage, 3) AS ball_coverage, coverage >= {CFG.min_coverage} AS available, coalesce(n_events, 0) AS n_events, CAST(coalesce(frames, 0) AS BIGINT) AS frames FROM cv LEFT JOIN c USING (clip_id)", "ball", recursive=True))
def events_json(spark, sf):
    from ..operators import shots

    found = _found(spark, sf)
    out = writers.events_payload(found, shots.shot_events(found, F.lit(30.0)))
    out = out.select("clip_id", F.from_json("value", "ball_coverage double, available boolean, reason string, events array<struct<frame:int,time_s:double,outcome:string>>").alias("r"))
    total = F.aggregate("r.events", F.lit(0).cast("long"), lambda s, e: s + e["frame"])
    return out.select("clip_id", "r.ball_coverage", "r.available", F.size("r.events").cast("long").alias("n_events"), total.alias("frames"))


@query("stats_json", sql("+" + _STATS.format(src="pos").lstrip().lstrip(","), "pos"))
def stats_json(spark, sf):
    path = scratch_folder(spark) + "/stats"
    stats = r4(paths.movement_stats(a.positions(spark, sf), PATH_MIN, cap=PATH_CAP), *STAT_COLS)
    meta = a.positions(spark, sf).groupBy("clip_id").agg(F.countDistinct("frame").alias("frames"), F.lit(30.0).alias("fps"))
    writers.write_texts(writers.stats_payload(stats, meta), path)
    shape = "meta struct<frames:long,fps:double>, players array<struct<track_id:long,team:int,frames:long,seconds:double,distance_ft:double,avg_speed_mph:double,top_speed_mph:double>>"
    return spark.read.schema(shape).json(path).select("clip_id", F.explode("players").alias("p")).select(F.col("clip_id").cast("long").alias("clip_id"), "p.*")


@query("box_score_json", sql(_TOTALS, "seg"))
def box_score_json(spark, sf):
    from ..operators import boxscore

    rows = a.segment_rows(spark, sf)
    totals = r4(boxscore.number_totals(rows), "seconds", "distance_ft", "avg_speed_mph")
    out = writers.box_score(totals, boxscore.identified_time(rows))
    player = "array<struct<number:string,segments:long,seconds:double,distance_ft:double,avg_speed_mph:double,top_speed_mph:double>>"
    return out.select(F.from_json("value", f"schema_version int, players {player}").alias("r")).filter("r.schema_version = 1").select(F.explode("r.players").alias("p")).select("p.*")


@query("resumed_segments", sql("SELECT segment, count(*) AS n, round(sum(seconds), 4) AS seconds FROM seg GROUP BY segment", "seg"))
def resumed_segments(spark, sf):
    """Half of the segments are there when the run starts; only the others are computed, and all are returned."""
    path, rows = scratch_folder(spark) + "/segments", a.segment_rows(spark, sf)
    todo = rows.select("segment").distinct()
    compute = lambda t: rows.join(t, "segment").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"))
    writers.fill_segments(todo.filter("segment % 2 = 0"), path, compute)
    return writers.fill_segments(todo, path, compute).select("segment", "n", "seconds")


# --- labels ---------------------------------------------------------------------------------------------------------


@query("label_edits", sql("+ e AS (SELECT frame, ord, CASE WHEN track_id = 3 THEN 5 ELSE track_id END AS gid FROM boxes), m AS (SELECT min(ord) AS o FROM boxes) SELECT frame, ord, CASE WHEN ord = (SELECT o FROM m) THEN 900000 ELSE gid END AS gid FROM e WHERE CASE WHEN ord = (SELECT o FROM m) THEN 900000 ELSE gid END <> 7", "boxes"))
def label_edits(spark, sf):
    """A track renamed, one box overridden, one track removed; a further removal is undone."""
    boxes = a.boxes(spark, sf).select("frame", "ord", F.col("track_id").alias("gid"))
    store, first = labels.LabelVersions(boxes), boxes.orderBy("ord").first()
    store.relabel(3, 5)
    store.override(first["frame"], first["ord"], 900_000)
    store.remove(7)
    store.remove(9)
    store.undo()
    return store.now


@query("box_lookup_tracks", sql("+ p AS (SELECT clip_id, frame, read_id, x1 + 1 AS px, y1 + 1 AS py FROM reads), q AS (SELECT p.read_id, b.ord, row_number() OVER (PARTITION BY p.read_id ORDER BY b.ord) AS rn FROM p JOIN boxes b ON b.clip_id = p.clip_id AND b.frame = p.frame AND p.px BETWEEN floor(b.x1) AND floor(b.x1) + 20 AND p.py BETWEEN b.y1 AND b.y1 + 20) SELECT p.read_id, q.ord FROM p LEFT JOIN q ON q.read_id = p.read_id AND q.rn = 1", "boxes", "reads"))
def box_lookup_tracks(spark, sf):
    # whole pixels, so that all boxes have the same area in both engines
    x = F.floor("box.x1").cast("double")
    b = a.boxes(spark, sf).withColumn("box", g.box(x, F.col("box.y1"), x + 20, F.col("box.y1") + 20))
    p = a.reads(spark, sf).select("clip_id", "frame", "read_id", (F.col("box.x1") + 1).alias("px"), (F.col("box.y1") + 1).alias("py"))
    return labels.box_at(b, p, ["clip_id", "frame"]).select("read_id", "ord")


@query("dataset_summary", sql("SELECT event_type AS source, count(*) AS images, round(avg(k), 4) AS mean_visible FROM ev GROUP BY 1", "ev"))
def dataset_summary(spark, sf):
    return r4(labels.dataset_summary(a.events(spark, sf).select(F.col("event_type").alias("source"), F.col("k").alias("n_visible"))), "mean_visible")


# --- frames, courts, geometry ---------------------------------------------------------------------------------------


@query("first_frames", sql("SELECT clip_id, i AS frame FROM ball WHERE i % 2 = 0 AND i < 20", "ball"))
def first_frames(spark, sf):
    """Every second frame, the first ten of these of each clip: the limit is what is asked for."""
    return segments.first_frames(a.ball(spark, sf).select("clip_id", F.col("i").alias("frame")), 2, 10)


@query("full_court_positions", sql(f"SELECT clip_id, frame, ord, track_id, round({_PX}, 4) AS x, round({_PY}, 4) AS y FROM boxes WHERE {_PX} BETWEEN -2 AND 96 AND {_PY} BETWEEN -2 AND 52", "boxes"))
def full_court_positions(spark, sf):
    out = paths.court_positions(a.boxes(spark, sf).withColumn("team", F.lit(None).cast("int")), a.matrix(), F.lit(30.0), margin=2.0, full=True)
    return r4(out, "x", "y").select("clip_id", "frame", "ord", "track_id", "x", "y")


@query("longest_distances", "SELECT clip_id, track_id, round(distance_ft, 1) AS distance_ft FROM (" + sql("+" + _STATS.format(src="pos").lstrip().lstrip(","), "pos") + ") ORDER BY round(distance_ft, 1) DESC, clip_id, track_id LIMIT 7")
def longest_distances(spark, sf):
    """The first seven of the presented order: the limit is what is asked for."""
    stats = r4(paths.movement_stats(a.positions(spark, sf), PATH_MIN, cap=PATH_CAP), *STAT_COLS)
    return paths.present(stats).select("clip_id", "track_id", "distance_ft").limit(7)


@query("report_rows", f"SELECT CAST(row_number() OVER (ORDER BY seconds DESC, number) AS BIGINT) AS place, number, segments FROM ({sql(_TOTALS, 'seg')}) ORDER BY place LIMIT 5")
def report_rows(spark, sf):
    """The first five rows of the Markdown report, read back: the limit is what is asked for."""
    from ..operators import boxscore

    text = writers.markdown_report(boxscore.number_totals(a.segment_rows(spark, sf)), 5)
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in text.split("\n")[2:]]
    return spark.createDataFrame([(k + 1, c[0], int(c[1])) for k, c in enumerate(cells)], "place long, number string, segments long")


@query("rescaled_boxes", sql("SELECT ord, round(x1 * 0.5e0, 4) AS x1, round(y2 * 0.25e0, 4) AS y2 FROM boxes", "boxes"))
def rescaled_boxes(spark, sf):
    b = g.rescale(F.col("box"), F.lit(0.5), F.lit(0.25))
    return a.boxes(spark, sf).select("ord", F.round(b["x1"], 4).alias("x1"), F.round(b["y2"], 4).alias("y2"))


@query("centred_boxes", sql("SELECT ord, round(x - 5, 4) AS x1, round(y - 2.5e0, 4) AS y1, round(x + 5, 4) AS x2, round(y + 2.5e0, 4) AS y2 FROM pos", "pos"))
def centred_boxes(spark, sf):
    b = g.from_center(F.col("x"), F.col("y"), F.lit(10.0), F.lit(5.0))
    return a.positions(spark, sf).select("ord", *[F.round(b[c], 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


_W = f"({H[6]}e0 * x + {H[7]}e0 * y + {H[8]}e0)"
_WX, _WY = f"({H[0]}e0 * x + {H[1]}e0 * y + {H[2]}e0) / {_W}", f"({H[3]}e0 * x + {H[4]}e0 * y + {H[5]}e0) / {_W}"


@query("warped_keypoints", sql(f"+ w AS (SELECT ord, {_WX} AS wx, {_WY} AS wy, coalesce(team, 2) AS v FROM pos) SELECT ord, CASE WHEN s THEN round(wx, 4) ELSE 0 END AS x, CASE WHEN s THEN round(wy, 4) ELSE 0 END AS y, CASE WHEN s THEN v ELSE 0 END AS v FROM (SELECT *, v > 0 AND wx >= 0 AND wx < 40 AND wy >= 0 AND wy < 30 AS s FROM w)", "pos"))
def warped_keypoints(spark, sf):
    k = a.positions(spark, sf).select("ord", "x", "y", F.coalesce("team", F.lit(2)).alias("v"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    return r4(registration.warped_keypoints(k, a.matrix()), "x", "y").select("ord", "x", "y", "v")


@query("curve_normals", sql("+ t AS (SELECT track_id, ord, CASE WHEN lag(x) OVER w IS NULL AND lead(x) OVER w IS NULL THEN 0 ELSE (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / CASE WHEN lag(x) OVER w IS NULL OR lead(x) OVER w IS NULL THEN 1 ELSE 2 END END AS tx, CASE WHEN lag(x) OVER w IS NULL AND lead(x) OVER w IS NULL THEN 0 ELSE (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / CASE WHEN lag(x) OVER w IS NULL OR lead(x) OVER w IS NULL THEN 1 ELSE 2 END END AS ty FROM pos WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, ord, round(-ty / CASE WHEN tx * tx + ty * ty > 0 THEN sqrt(tx * tx + ty * ty) ELSE 1 END, 4) + 0e0 AS nx, round(tx / CASE WHEN tx * tx + ty * ty > 0 THEN sqrt(tx * tx + ty * ty) ELSE 1 END, 4) + 0e0 AS ny FROM t", "pos"))
def curve_normals(spark, sf):
    out = registration.curve_normals(a.positions(spark, sf).select("track_id", "ord", "frame", "x", "y"), ["track_id"], "frame")
    return out.select("track_id", "ord", (F.round("nx", 4) + 0.0).alias("nx"), (F.round("ny", 4) + 0.0).alias("ny"))


def _circle_sql(line: str, cx: float, cy: float, r: float, lo: str, hi: str, n: int, steps: int, side: int = 1) -> str:
    return f"SELECT '{line}' AS line, CAST(i AS INTEGER) AS i, round({cx} + {side} * {r} * cos({lo} + i * ({hi} - ({lo})) / {steps}), 4) AS x, round({cy} + {r} * sin({lo} + i * ({hi} - ({lo})) / {steps}), 4) AS y FROM range({n}) t(i)"


_LINES = " UNION ALL ".join([
    "SELECT line, CAST(i AS INTEGER) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES ('outer', 0, 0, 0), ('outer', 1, 94, 0), ('outer', 2, 94, 50), ('outer', 3, 0, 50), ('outer', 4, 0, 0), ('half', 0, 47, 0), ('half', 1, 47, 50), "
    "('left-paint', 0, 0, 17), ('left-paint', 1, 19, 17), ('left-paint', 2, 19, 33), ('left-paint', 3, 0, 33), ('right-paint', 0, 94, 17), ('right-paint', 1, 75, 17), ('right-paint', 2, 75, 33), ('right-paint', 3, 94, 33), "
    "('left-corner-low', 0, 0, 3), ('left-corner-low', 1, 14, 3), ('left-corner-high', 0, 0, 47), ('left-corner-high', 1, 14, 47), ('right-corner-low', 0, 94, 3), ('right-corner-low', 1, 80, 3), ('right-corner-high', 0, 94, 47), ('right-corner-high', 1, 80, 47)) v(line, i, x, y)",
    _circle_sql("center-circle", 47, 25, 6, "0e0", "2 * pi()", 60, 59),
    _circle_sql("left-circle", 19, 25, 6, "0e0", "2 * pi()", 60, 59), _circle_sql("right-circle", 75, 25, 6, "0e0", "2 * pi()", 60, 59),
    _circle_sql("left-arc", 5.25, 25, 23.75, "-1.2e0", "1.2e0", 60, 59), _circle_sql("right-arc", 88.75, 25, 23.75, "-1.2e0", "1.2e0", 60, 59, -1),
])


@query("court_lines", _LINES)
def court_lines(spark, sf):
    return r4(courts.full_lines(spark), "x", "y")


@query("court_curves", " UNION ALL ".join([
    _circle_sql("three", 25, 5.25, 23.75, "0.39e0", "pi() - 0.39e0", 80, 79), _circle_sql("center", 25, 47, 6, "pi()", "2 * pi()", 40, 39),
    _circle_sql("ft-circle", 25, 19, 6, "0e0", "2 * pi()", 40, 40), "SELECT 'halfcourt' AS line, CAST(i AS INTEGER) AS i, 0.5e0 + i AS x, 47e0 AS y FROM range(50) t(i)",
]))
def court_curves(spark, sf):
    return r4(courts.half_curves(spark, sorted(courts.CURVES)), "x", "y")


@query("heatmap_peaks", sql("""+ c AS (SELECT user_id % 5 AS image_id, event_id % 40 AS x, k AS y, max(value) AS score FROM ev GROUP BY ALL),
  m AS (SELECT c.*, (SELECT max(d.score) FROM c d WHERE d.image_id = c.image_id AND d.x BETWEEN c.x - 1 AND c.x + 1 AND d.y BETWEEN c.y - 1 AND c.y + 1) AS best FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x) AS n FROM m WHERE score >= best AND score >= 50)
  SELECT image_id, x, y, score, round((x + 0.5e0) * 4 - 4, 4) AS x1, round(y * 4 + 2e0, 4) AS y2 FROM r WHERE n <= 64""", "ev"))
def heatmap_peaks(spark, sf):
    """The 64 best peaks of an image: the limit is what is asked for."""
    e = a.events(spark, sf)
    c = e.groupBy((F.col("user_id") % 5).alias("image_id"), (F.col("event_id") % 40).alias("x"), F.col("k").alias("y")).agg(F.max("value").alias("score"))
    c = c.withColumns({"w": F.lit(2.0), "h": F.lit(1.0), "dx": F.lit(0.5), "dy": F.lit(-0.5)})
    out = heatmaps.peaks(c, 64, 50.0)
    return out.select("image_id", "x", "y", "score", F.round("box.x1", 4).alias("x1"), F.round("box.y2", 4).alias("y2"))


@query("paint_corner_order", sql("SELECT event_id AS id, round(value - 8, 4) AS blx, round(value + 8, 4) AS brx, round(value - 6, 4) AS flx, round(value + 6, 4) AS frx FROM ev", "ev"))
def paint_corner_order(spark, sf):
    """Lanes seen from behind the basket, their corners listed from another one each time."""
    e = a.events(spark, sf).withColumn("v", F.col("value"))
    at = lambda dx, y: g.point(F.col("v") + dx, F.lit(float(y)))
    ring = [at(-8, 100), at(6, 60), at(8, 100), at(-6, 60)]
    turn = [F.array(*[ring[(i + s) % 4] for i in range(4)]) for s in range(4)]
    points = F.when(F.col("k") % 4 == 0, turn[0]).when(F.col("k") % 4 == 1, turn[1]).when(F.col("k") % 4 == 2, turn[2]).otherwise(turn[3])
    out = registration.ordered_corners(e.select(F.col("event_id").alias("id"), points.alias("points"), at(0, 98).alias("basket")))
    return out.select("id", *[F.round(f"{c}.x", 4).alias(n) for c, n in (("baseline_left", "blx"), ("baseline_right", "brx"), ("ft_left", "flx"), ("ft_right", "frx"))])


@query("recovered_template", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in sorted(courts.planar().items())) + ") t(kp, x, y)")
def recovered_template(spark, sf):
    """The whole floor from views of it by many cameras, when only the left end is known."""
    k, _ = _keypoints(spark, sf)
    obs = k.filter(~F.col("kp").isin(*courts.ELEVATED)).select(F.concat_ws("-", "clip_id", "frame").alias("image_id"), "kp", "x", "y")
    known = {i: p for i, p in courts.planar().items() if p[0] <= 29}
    found = registration.recovered_template(obs, known)
    return spark.createDataFrame([(int(i), round(float(x), 2) + 0.0, round(float(y), 2) + 0.0) for i, (x, y) in sorted(found.items())], "kp int, x double, y double")


@query("identity_pass", sql("+" + _CONFIRM + ", " + _MERGE.replace("nb AS (SELECT clip_id, track_id, CAST(track_id % 3 AS VARCHAR) AS number FROM (SELECT DISTINCT clip_id, track_id FROM boxes))", "nb AS (SELECT clip_id, track_id, number FROM cf)") + " SELECT clip_id, track_id, canonical_id FROM rm", "boxes", "reads", recursive=True))
def identity_pass(spark, sf):
    _, spans = _merge_inputs(spark, sf)
    return identity.identify(a.reads(spark, sf), a.boxes(spark, sf), spans, min_share=0.3)[0]


@query("affine_products", sql("""+ m AS (SELECT clip_id, i, CASE WHEN bx IS NOT NULL THEN bx / 600 END AS s, CASE WHEN bx IS NOT NULL THEN by_ / 100 END AS t FROM ball),
  p AS (SELECT clip_id, i, coalesce(cos(s), 1) AS a, coalesce(-sin(s), 0) AS b, coalesce(t, 0) AS c, coalesce(sin(s), 0) AS d, coalesce(cos(s), 1) AS e, coalesce(-t, 0) AS f FROM m WHERE i = 0
    UNION ALL SELECT p.clip_id, m.i, p.a * coalesce(cos(s), 1) + p.b * coalesce(sin(s), 0), p.a * coalesce(-sin(s), 0) + p.b * coalesce(cos(s), 1), p.a * coalesce(t, 0) + p.b * coalesce(-t, 0) + p.c,
      p.d * coalesce(cos(s), 1) + p.e * coalesce(sin(s), 0), p.d * coalesce(-sin(s), 0) + p.e * coalesce(cos(s), 1), p.d * coalesce(t, 0) + p.e * coalesce(-t, 0) + p.f FROM p JOIN m ON m.clip_id = p.clip_id AND m.i = p.i + 1)
  SELECT clip_id, CAST(i AS BIGINT) AS frame, round(a, 4) + 0e0 AS a, round(b, 4) + 0e0 AS b, round(c, 3) + 0e0 AS c, round(f, 3) + 0e0 AS f FROM p""", "ball", recursive=True))
def affine_products(spark, sf):
    s, t = F.col("bx") / 600, F.col("by_") / 100
    m = F.when(F.col("bx").isNotNull(), F.array(F.cos(s), -F.sin(s), t, F.sin(s), F.cos(s), -t))
    out = registration.accumulated_motion(a.ball(spark, sf).select("clip_id", F.col("i").alias("frame"), m.alias("affine")))
    return out.select("clip_id", "frame", *[(F.round(F.col("h")[k], n) + 0.0).alias(c) for k, n, c in ((0, 4, "a"), (1, 4, "b"), (2, 3, "c"), (5, 3, "f"))])


# --- SQL for queries of the catalogue that had none -----------------------------------------------------------------

_FRAMES = """fr AS (SELECT DISTINCT CAST(user_id % 8 AS VARCHAR) AS clip_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame FROM ev)"""
_FULL_SQL = ", ".join(f"({i}, {x}e0)" for i, (x, _) in sorted(courts.planar().items()))
_AVAILABLE = f"""{_FRAMES}, tp(kp, fx) AS (VALUES {_FULL_SQL}),
sn AS (SELECT clip_id, frame, (SELECT count(*) FROM tp WHERE abs(fx - (frame * 11) % 94) <= 32) AS n FROM fr),
lg AS (SELECT *, row_number() OVER w AS r, n >= 4 AS good FROM sn WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
av AS (SELECT clip_id, frame, coalesce(r - max(CASE WHEN good THEN r END) OVER (PARTITION BY clip_id ORDER BY frame) <= 15, FALSE) AS ok FROM lg)"""
ORACLE["registration_rate"] = sql("+" + _AVAILABLE + ", q AS (SELECT clip_id, avg(CAST(ok AS INTEGER)) AS rate FROM av GROUP BY clip_id) SELECT clip_id, rate, CASE WHEN rate >= 0.8 THEN 'ok' ELSE 'unavailable' END AS court_analytics FROM q", "ev")
ORACLE["registered_frames"] = sql("+" + _AVAILABLE + f" SELECT clip_id, frame, CASE WHEN ok THEN {H[0]}e0 END AS h0, CASE WHEN ok THEN {H[4]}e0 END AS h4, CASE WHEN ok THEN {H[8]}e0 END AS h8 FROM av", "ev")


def _inverse_h() -> list[float]:
    """The inverse of H from its cofactors, up to scale."""
    p, q, r, s, t, u, v, w, z = H
    return [t * z - u * w, r * w - q * z, q * u - r * t, u * v - s * z, p * z - r * v, r * s - p * u, s * w - t * v, q * v - p * w, p * t - q * s]


_B = [f"({x!r}::DOUBLE)" for x in _inverse_h()]
_HALF = ", ".join(f"({i}, {f'{p[0]}e0' if p else 'NULL'}, {f'{p[1]}e0' if p else 'NULL'}, {m})" for i, p, m in ((i, p, courts.mirror_index("ncaa").get(i)) for i, p in enumerate(courts.half_court("ncaa").values())) for m in [m if m is not None else "NULL"])
ORACLE["visible_landmarks"] = sql(
    f"""+ tp(kp, fx, fy, mk) AS (VALUES {_HALF}), us AS (SELECT DISTINCT user_id AS clip_id FROM ev),
    pr AS (SELECT *, ({_B[0]} * fx + {_B[1]} * fy + {_B[2]}) / ({_B[6]} * fx + {_B[7]} * fy + {_B[8]}) AS px, ({_B[3]} * fx + {_B[4]} * fy + {_B[5]}) / ({_B[6]} * fx + {_B[7]} * fy + {_B[8]}) AS py FROM tp),
    vs AS (SELECT *, coalesce(px >= 0 AND px < 1280 AND py >= 0 AND py < 720, FALSE) AS s FROM pr)
    SELECT clip_id, mk AS kp, round(CASE WHEN s THEN 1279 - px ELSE 0 END, 4) AS x, round(CASE WHEN s THEN py ELSE 0 END, 4) AS y, CASE WHEN s THEN 2 ELSE 0 END AS v FROM us, vs""",
    "ev",
)
