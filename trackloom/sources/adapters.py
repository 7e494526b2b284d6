"""Tracking tables made from the star-schema tables, for queries that need such input.

Each adapter is a plain projection that SQL can state as well; SQL_VIEWS has that statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: An image-to-feet homography for queries that project points.
H = [0.55, 0.02, 1.0, 0.01, 0.9, 0.5, 0.0004, 0.0006, 1.0]
RIM = (20.0, 30.0, 40.0, 50.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix():
    return F.array(*[F.lit(v) for v in H])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _nth(by: str):
    return (F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id")) - 1).cast("long")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court positions: a user is a track, the user's n-th event its n-th second."""
    e = events(spark, sf_dir).withColumn("frame", _nth("user_id"))
    team = F.when(F.col("k") % 3 != 2, F.col("k") % 3)
    return e.select(
        (F.col("user_id") % 4).alias("clip_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("ord"), "frame",
        F.col("frame").cast("double").alias("t"), (F.col("value") % F.lit(94.0)).alias("x"), (F.col("k") % 50).cast("double").alias("y"), team.alias("team"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player boxes of 20 by 20 from views and clicks, a day a frame."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    x, y = F.col("value") % F.lit(80.0), (F.col("k") % 40).cast("double")
    return e.select(
        (F.col("user_id") % 2).alias("clip_id"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("frame"),
        F.col("user_id").alias("track_id"), F.col("event_id").alias("ord"), g.box(x, y, x + 20, y + 20).alias("box"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number reads of 6 by 6 from purchases."""
    e = events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    x, y = F.col("value") % F.lit(80.0) + 2, (F.col("k") % 40).cast("double") + 2
    return e.select(
        (F.col("user_id") % 2).alias("clip_id"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("frame"),
        F.col("event_id").alias("read_id"), g.box(x, y, x + 6, y + 6).alias("box"), (F.col("k") % 10).cast("string").alias("number"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration samples: an error is a failed one; frames are microseconds."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("clip_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("frame"), (F.col("event_type") != "error").alias("registered"))


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense ball track per user, without a ball on errors."""
    e = events(spark, sf_dir).withColumn("i", _nth("user_id"))
    seen = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").alias("clip_id"), F.col("i").cast("int").alias("i"),
        F.when(seen, F.col("value") % F.lit(60.0)).alias("bx"), F.when(seen, F.col("k").cast("double")).alias("by_"),
    )


def rims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rim = g.box(*[F.lit(v) for v in RIM])
    return events(spark, sf_dir).select(F.col("user_id").alias("clip_id")).distinct().withColumn("rim", rim)


def timed(spark: SparkSession, sf_dir: str, kind: str, ord_name: str) -> DataFrame:
    """Events of a kind as shots: seconds since 1970 and an outcome."""
    e = events(spark, sf_dir).filter(F.col("event_type") == kind)
    made = F.when(F.col("k") % 2 == 0, "made").otherwise("missed")
    return e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias(ord_name), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time_s"), made.alias("outcome"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-segment player rows for the box score: a day a segment."""
    e = events(spark, sf_dir)
    number = F.nullif((F.col("k") % 40).cast("string"), F.lit("0"))
    return e.select(
        F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("segment"), F.col("user_id").alias("track_id"), number.alias("number"),
        F.col("value").alias("seconds"), (F.col("value") * 3 + F.col("k")).alias("distance_ft"), (F.col("k") % 20).cast("double").alias("top_speed_mph"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of users over their days: ordinal i within the clip, the box of the day's last event."""
    b = events(spark, sf_dir).withColumn("i", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("user_id", "i").orderBy(F.desc("event_id"))
    b = b.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    x, y = F.col("value") % F.lit(80.0), (F.col("k") % 40).cast("double")
    lo = events(spark, sf_dir).agg(F.min(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))).alias("lo"))
    b = b.join(F.broadcast(lo))  # one row
    return b.select(
        (F.col("user_id") % 10).alias("clip_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("ord"), (F.col("i") - F.col("lo")).cast("int").alias("i"),
        g.box(x, y, x + 20, y + 20).alias("box"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance vectors of tracks: every embedding, dealt in turn to all users but user 0, who has none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("feature"))
    users = events(spark, sf_dir).select((F.col("user_id") % 10).alias("clip_id"), F.col("user_id").alias("track_id")).distinct()
    top = users.agg(F.max("track_id").alias("top"))  # one row
    dealt = e.join(F.broadcast(top)).select((F.col("vec_id") % F.col("top") + 1).alias("track_id"), "feature")
    return users.join(dealt, "track_id").select("clip_id", "track_id", "feature")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored boxes from orders: a customer is an image."""
    o = table(spark, sf_dir, "orders")
    x, y = (F.col("o_orderkey") % 37).cast("double"), (F.col("o_orderkey") % 23).cast("double")
    return o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("det_ord"), g.box(x, y, x + 20, y + 20).alias("box"), (F.col("o_totalprice") + F.col("o_orderkey") / F.lit(1e9)).alias("score"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes from orders, elsewhere than the detections."""
    o = table(spark, sf_dir, "orders")
    x, y = (F.col("o_orderkey") % 41).cast("double"), (F.col("o_orderkey") % 19).cast("double")
    return o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("truth_ord"), g.box(x, y, x + 20, y + 20).alias("box"))


_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)"
SQL_VIEWS = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "pos": """SELECT user_id % 4 AS clip_id, user_id AS track_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS t, value % 94e0 AS x, CAST(k % 50 AS DOUBLE) AS y,
        CASE WHEN k % 3 <> 2 THEN k % 3 END AS team FROM ev""",
    "boxes": f"""SELECT user_id % 2 AS clip_id, {_DAY} AS frame, user_id AS track_id, event_id AS ord, value % 80e0 AS x1, CAST(k % 40 AS DOUBLE) AS y1,
        value % 80e0 + 20 AS x2, CAST(k % 40 AS DOUBLE) + 20 AS y2 FROM ev WHERE event_type IN ('view', 'click')""",
    "reads": f"""SELECT user_id % 2 AS clip_id, {_DAY} AS frame, event_id AS read_id, value % 80e0 + 2 AS x1, CAST(k % 40 AS DOUBLE) + 2 AS y1,
        value % 80e0 + 8 AS x2, CAST(k % 40 AS DOUBLE) + 8 AS y2, CAST(k % 10 AS VARCHAR) AS number FROM ev WHERE event_type = 'purchase'""",
    "samples": "SELECT user_id AS clip_id, epoch_us(ts) AS frame, event_type <> 'error' AS registered FROM ev",
    "ball": """SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i,
        CASE WHEN event_type <> 'error' THEN value % 60e0 END AS bx, CASE WHEN event_type <> 'error' THEN CAST(k AS DOUBLE) END AS by_ FROM ev""",
    "shots": "SELECT user_id AS clip_id, event_id AS event_ord, epoch_us(ts) / 1e6 AS time_s, CASE WHEN k % 2 = 0 THEN 'made' ELSE 'missed' END AS outcome FROM ev WHERE event_type = 'purchase'",
    "facts": "SELECT user_id AS clip_id, event_id AS truth_ord, epoch_us(ts) / 1e6 AS time_s, CASE WHEN k % 2 = 0 THEN 'made' ELSE 'missed' END AS outcome FROM ev WHERE event_type = 'click'",
    "seg": f"""SELECT {_DAY} AS segment, user_id AS track_id, nullif(CAST(k % 40 AS VARCHAR), '0') AS number, value AS seconds, value * 3 + k AS distance_ft,
        CAST(k % 20 AS DOUBLE) AS top_speed_mph FROM ev""",
    "daily": f"""SELECT user_id % 10 AS clip_id, user_id AS track_id, event_id AS ord, CAST(d - min(d) OVER () AS INTEGER) AS i, value % 80e0 AS x1, CAST(k % 40 AS DOUBLE) AS y1,
        value % 80e0 + 20 AS x2, CAST(k % 40 AS DOUBLE) + 20 AS y2
        FROM (SELECT *, {_DAY} AS d, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY event_id DESC) AS r FROM ev) WHERE r = 1""",
    "feats": """SELECT u.clip_id, u.track_id, embedding AS feature FROM (SELECT DISTINCT user_id % 10 AS clip_id, user_id AS track_id FROM ev) u
        JOIN embeddings e ON u.track_id = e.vec_id % (SELECT max(user_id) FROM ev) + 1""",
    "dets": """SELECT o_custkey AS image_id, o_orderkey AS det_ord, CAST(o_orderkey % 37 AS DOUBLE) AS x1, CAST(o_orderkey % 23 AS DOUBLE) AS y1,
        CAST(o_orderkey % 37 AS DOUBLE) + 20 AS x2, CAST(o_orderkey % 23 AS DOUBLE) + 20 AS y2, o_totalprice + o_orderkey / 1e9 AS score FROM orders""",
    "gts": """SELECT o_custkey AS image_id, o_orderkey AS truth_ord, CAST(o_orderkey % 41 AS DOUBLE) AS x1, CAST(o_orderkey % 19 AS DOUBLE) AS y1,
        CAST(o_orderkey % 41 AS DOUBLE) + 20 AS x2, CAST(o_orderkey % 19 AS DOUBLE) + 20 AS y2 FROM orders""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the views it names in front; a leading + says that it goes on with views of its own."""
    used = [n for n in dict.fromkeys(names) if n != "ev"]
    if "FROM ev" in body or any("FROM ev" in SQL_VIEWS[n] for n in used):
        used = ["ev", *used]
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in used)
    more = body.lstrip().startswith("+")
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if more else ' '}{body.lstrip().removeprefix('+')}"
