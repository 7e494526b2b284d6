"""Readers of the text and JSON files that tracking data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOT = "frame int, id int, x double, y double, w double, h double, conf string, a string, b string, c string"
CALIBRATION = "homography array<array<double>>, image_points array<array<double>>, court_points array<array<double>>"
COCO = (
    "images array<struct<id:bigint,file_name:string,width:double,height:double>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,keypoints:array<double>,bbox:array<double>>>, "
    "categories array<struct<id:bigint,name:string,keypoints:array<string>>>"
)


def _clip() -> Column:
    """The file's name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")


def mot(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(clip_id, frame, id, x, y, w, h, conf) of header-less CSV files; no or negative confidence is 1.

    folder: the key of the folders that name the clips, if it is not the files that name them.
    """
    df = spark.read.schema(MOT).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("frame is not null")
    conf = F.when(F.coalesce(F.col("conf"), F.lit("")).isin("", "-1"), 1.0).otherwise(F.col("conf").cast("double"))
    return df.select((F.col(folder) if folder else _clip()).alias("clip_id"), "frame", "id", "x", "y", "w", "h", conf.alias("conf"))


def mot_frames(boxes: DataFrame, key: str = "clip_id") -> DataFrame:
    """Every frame from 1 to the last of a clip, those without boxes too."""
    return boxes.groupBy(key).agg(F.max("frame").alias("n")).select(key, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("frame"))


def shot_labels(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, truth_ord, time_s, outcome) of CSV files with a header; a missing path is an error."""
    df = spark.read.schema("time_s double, outcome string").csv(path, header=True)
    out = df.select(_clip().alias("clip_id"), F.monotonically_increasing_id().alias("truth_ord"), "time_s", F.trim("outcome").alias("outcome"))
    return out


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(homography row-major, image_points, court_points)"""
    df = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    return df.withColumn("homography", F.flatten("homography"))


def coco_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, ann_id, kp, x, y, v): annotations of the category that has keypoints."""
    df = spark.read.schema(COCO).json(path, multiLine=True).withColumn("_f", F.input_file_name())
    cat = df.select("_f", F.explode("categories").alias("c")).filter(F.size("c.keypoints") > 0).groupBy("_f").agg(F.min("c.id").alias("category_id"))
    img = df.select("_f", F.explode("images").alias("i")).select("_f", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    ann = df.select("_f", F.explode("annotations").alias("a")).select("_f", F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", "a.keypoints")
    k = F.col("keypoints")
    trio = F.transform(F.sequence(F.lit(0), (F.size(k) / 3 - 1).cast("int")), lambda i: F.struct(F.get(k, (3 * i).cast("int")).alias("x"), F.get(k, (3 * i + 1).cast("int")).alias("y"), F.get(k, (3 * i + 2).cast("int")).cast("int").alias("v")))
    joined = ann.join(cat, ["_f", "category_id"]).join(img, ["_f", "image_id"]).filter(F.size(k) >= 3)
    return joined.select("image_id", "file_name", "width", "height", "ann_id", F.posexplode(trio).alias("kp", "p")).select(
        "image_id", "file_name", "width", "height", "ann_id", "kp", "p.x", "p.y", "p.v"
    )


def yolo_boxes(spark: SparkSession, path: str, cls: int = 0) -> DataFrame:
    """(image, cx, cy, w, h) of label lines of one class with at least five fields."""
    df = spark.read.text(path).select(_clip().alias("image"), F.split(F.trim("value"), r"\s+").alias("f"))
    df = df.filter((F.size("f") >= 5) & (F.get("f", F.lit(0)).cast("int") == cls))
    return df.select("image", *[F.get("f", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def ocr(spark: SparkSession, path: str, abstain: str = "unreadable") -> DataFrame:
    """(image, label) of JSON lines with prefix and suffix; an empty suffix is a number that cannot be read."""
    df = spark.read.schema("image string, prefix string, suffix string").json(path)
    return df.select("image", F.when(F.coalesce("suffix", F.lit("")) == "", abstain).otherwise(F.col("suffix")).alias("label"))


def clip_info(df: DataFrame) -> DataFrame:
    """clips(clip_id, fps, frame_count, …) with a rate of 30 where none is known, and the duration."""
    fps = F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(30.0))
    return df.withColumn("fps", fps).withColumn("duration_s", F.coalesce(F.try_divide(F.col("frame_count"), F.col("fps")), F.lit(0.0)))
