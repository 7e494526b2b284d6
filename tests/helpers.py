"""Small builders for test tables."""

from __future__ import annotations


def box(x1, y1, x2, y2):
    return (float(x1), float(y1), float(x2), float(y2))


BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
XY = "struct<x:double,y:double>"


def path(spark, rows):
    """(track, ord, t, x, y, team)"""
    return spark.createDataFrame([(0, *r) for r in rows], "clip_id int, track_id int, ord int, t double, x double, y double, team int")


def ball(spark, points):
    rows = [(0, i, *(map(float, p) if p else (None, None))) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "clip_id int, i int, bx double, by_ double")
