"""Totals per jersey number over the segments of a game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import MPH


def number_totals(rows: DataFrame) -> DataFrame:
    """rows(segment, track_id, number, seconds, distance_ft, top_speed_mph) summed by number; the average from totals."""
    out = rows.filter(F.col("number").isNotNull()).groupBy("number").agg(
        F.countDistinct("segment").alias("segments"), F.sum("seconds").alias("seconds"),
        F.sum("distance_ft").alias("distance_ft"), F.max("top_speed_mph").alias("top_speed_mph"),
    )
    avg = F.when(F.col("seconds") > 0, F.col("distance_ft") / F.col("seconds") * MPH).otherwise(0.0)
    return out.withColumn("avg_speed_mph", avg)


def identified_time(rows: DataFrame, places: int = 1) -> DataFrame:
    """One row: what is attached to numbers and what stays anonymous; per-number seconds are rounded before they are summed."""
    named = F.col("number").isNotNull()
    each = rows.groupBy("number").agg(F.sum("seconds").alias("s"), F.sum("distance_ft").alias("d"), F.count(F.lit(1)).alias("n"))
    out = each.agg(
        F.count_if(named).alias("identified_numbers"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("identified_rows"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("anonymous_rows"),
        F.coalesce(F.sum(F.when(~named, F.col("s"))), F.lit(0.0)).alias("anonymous_seconds"),
        F.coalesce(F.sum(F.when(~named, F.col("d"))), F.lit(0.0)).alias("anonymous_distance_ft"),
        F.coalesce(F.sum(F.when(named, F.round("s", places))), F.lit(0.0)).alias("_ided"),
    )
    whole = F.col("_ided") + F.col("anonymous_seconds")
    return out.withColumn("identified_time_fraction", F.when(whole > 0, F.col("_ided") / whole).otherwise(0.0)).drop("_ided")


def best(rows: DataFrame, by: str) -> DataFrame:
    """The row with the greatest value of a column."""
    return rows.orderBy(F.desc(by)).limit(1)
