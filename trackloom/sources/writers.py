"""Writers of the formats that other tools read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mot_lines(boxes: DataFrame) -> DataFrame:
    """boxes(clip_id, i, track_id, box, conf) as lines of MOT text; frames count from 1."""
    b = F.col("box")
    line = F.format_string(
        "%d,%d,%.1f,%.1f,%.1f,%.1f,%.3f,-1,-1,-1", F.col("i") + 1, F.col("track_id"), b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"], F.coalesce("conf", F.lit(1.0))
    )
    return boxes.orderBy("clip_id", "i", "track_id").select("clip_id", line.alias("value"))


def write_mot(boxes: DataFrame, path: str) -> None:
    mot_lines(boxes).write.partitionBy("clip_id").mode("overwrite").text(path)


def write_calibration(spark: SparkSession, homography: list[float], image_points, court_points, path: str) -> None:
    payload = {
        "homography": [homography[i : i + 3] for i in (0, 3, 6)],
        "image_points": [list(p) for p in image_points], "court_points": [list(p) for p in court_points],
    }
    spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def events_payload(found: DataFrame, events: DataFrame, key: str = "clip_id") -> DataFrame:
    """One JSON text per clip: coverage to three places, whether and why analysis is unavailable, the events."""
    e = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", F.round("time_s", 3).alias("time_s"), "outcome"))).alias("events"))
    none = F.array().cast(e.schema["events"].dataType)
    out = found.select(key, F.round("coverage", 3).alias("ball_coverage"), "available", "reason").join(e, key, "left")
    return out.select(key, F.to_json(F.struct("ball_coverage", "available", "reason", F.coalesce("events", none).alias("events")), {"ignoreNullFields": "false"}).alias("value"))


def coco_records(points: DataFrame) -> DataFrame:
    """points(image_id, kp, x, y, v) as one COCO annotation per image, in JSON."""
    visible = F.col("v") > 0
    per = points.groupBy("image_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "v"))), lambda p: F.array(p["x"], p["y"], p["v"].cast("double")))).alias("keypoints"),
        F.count_if(visible).alias("num_keypoints"),
        *[f(F.when(visible, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "x1"), (F.min, "y", "y1"), (F.max, "x", "x2"), (F.max, "y", "y2"))],
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    box = F.array(z(F.col("x1")), z(F.col("y1")), z(F.col("x2") - F.col("x1")), z(F.col("y2") - F.col("y1")))
    return per.select("image_id", F.to_json(F.struct("image_id", "keypoints", "num_keypoints", box.alias("bbox"))).alias("value"))


def yolo_pose_lines(images: DataFrame, points: DataFrame, digits: int | None = 6) -> DataFrame:
    """(file_name, value): a pose label line per image, empty where an image has no points; coordinates in shares of the image.

    Without digits, numbers are written in full, so that they are read back as they were.
    """
    text = lambda c: c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c)
    n = lambda v, by: F.when(F.col("v") > 0, F.col(v) / F.col(by)).otherwise(0.0)
    p = points.join(images.select("image_id", "width", "height"), "image_id").select("image_id", "kp", "v", n("x", "width").alias("x"), n("y", "height").alias("y"))
    vis = F.col("v") > 0
    per = p.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("kp", "x", "y", "v"))).alias("k"),
        *[f(F.when(vis, F.col(c))).alias(a) for f, c, a in ((F.min, "x", "x1"), (F.min, "y", "y1"), (F.max, "x", "x2"), (F.max, "y", "y2"))],
    )
    part = lambda c: text(F.coalesce(c, F.lit(0.0)))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    head = F.concat_ws(" ", F.lit("0"), part((x1 + x2) / 2), part((y1 + y2) / 2), part(x2 - x1), part(y2 - y1))
    tail = F.array_join(F.transform("k", lambda q: F.concat_ws(" ", text(q["x"]), text(q["y"]), q["v"].cast("string"))), " ")
    out = images.select("image_id", "file_name").join(per.select("image_id", F.concat_ws(" ", head, tail).alias("value")), "image_id", "left")
    return out.select("file_name", F.coalesce("value", F.lit("")).alias("value"))


def stats_payload(stats: DataFrame, meta: DataFrame, key: str = "clip_id") -> DataFrame:
    """(clip, value): one JSON text per clip with its meta row and its players, longest distance first.

    stats(clip, track_id, …) and meta(clip, …) may have any further columns; a clip without players has an empty list.
    """
    cols = [c for c in stats.columns if c != key]
    row = F.struct((-F.col("distance_ft")).alias("o"), F.struct(*cols).alias("p"))
    per = stats.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"]).alias("players"))
    none = F.array().cast(per.schema["players"].dataType)
    out = meta.select(key, F.struct(*[c for c in meta.columns if c != key]).alias("meta")).join(per, key, "left")
    return out.select(key, F.to_json(F.struct("meta", F.coalesce("players", none).alias("players")), {"ignoreNullFields": "false"}).alias("value"))


def write_texts(texts: DataFrame, path: str, key: str = "clip_id") -> None:
    """texts(clip, value) as text files, a folder for each clip."""
    texts.write.partitionBy(key).mode("overwrite").text(path)


def box_score(totals: DataFrame, meta: DataFrame) -> DataFrame:
    """The box score as one JSON text: schema_version 1, the residual and a row per number, longest time first."""
    rows = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("o"), "number", "segments", "seconds", "distance_ft", "avg_speed_mph", "top_speed_mph"))).alias("r"))
    players = F.transform("r", lambda x: x.dropFields("o"))
    m = meta.select(F.struct(*meta.columns).alias("meta"))
    return rows.join(m).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "meta", players.alias("players"))).alias("value"))


def markdown_report(totals: DataFrame, limit: int = 50) -> str:
    """The first rows of the box score as a Markdown table."""
    rows = totals.orderBy(F.desc("seconds"), "number").limit(limit).collect()
    head = ["| # | segments | seconds | feet | avg mph | top mph |", "|---|---|---|---|---|---|"]
    return "\n".join(head + [f"| {r['number']} | {r['segments']} | {r['seconds']:.1f} | {r['distance_ft']:.1f} | {r['avg_speed_mph']:.1f} | {r['top_speed_mph']:.1f} |" for r in rows])


def fill_segments(todo: DataFrame, path: str, compute) -> DataFrame:
    """The results of all segments, computing only those not yet under path (partitioned by segment)."""
    spark = todo.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        todo = todo.join(spark.read.parquet(path).select("segment").distinct(), "segment", "left_anti")
    if not todo.isEmpty():
        compute(todo).write.partitionBy("segment").mode("append").parquet(path)
    return spark.read.parquet(path)
