"""Tracks in long form: one row a point (track_id, frame, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import PhysicalScale


def exploded(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.explode("points").alias("p")).select("track_id", "p.frame", "p.x", "p.y")


def trajectory_velocities(points: DataFrame, scale: PhysicalScale | None = None, key: str = "track_id") -> DataFrame:
    """``points`` with u, v: differences of the neighbours on the track by their frames apart, one-sided at the ends."""
    w = Window.partitionBy(key).orderBy("frame")
    k = scale.pixel_size / scale.dt if scale else 1.0
    lo, hi = F.coalesce(F.lag("frame").over(w), F.col("frame")), F.coalesce(F.lead("frame").over(w), F.col("frame"))
    rate = lambda c: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / F.when(hi > lo, hi - lo) * k
    return points.withColumns({"u": F.coalesce(rate("x"), F.lit(float("nan"))), "v": F.coalesce(rate("y"), F.lit(float("nan")))})


def track_summary(points: DataFrame, key: str = "track_id") -> DataFrame:
    """(track, start_frame, n, gaps, mean_speed): missing frames, and path length by time."""
    w = Window.partitionBy(key).orderBy("frame")
    p = points.withColumn("_d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).withColumn("_g", F.col("frame") - F.lag("frame").over(w))
    return p.groupBy(key).agg(F.min("frame").alias("start_frame"), F.count("*").alias("n"), F.coalesce(F.sum(F.col("_g") - 1), F.lit(0)).alias("gaps"), (F.sum("_d") / F.sum("_g")).alias("mean_speed"))


def trajectory_points(tracks: DataFrame) -> DataFrame:
    """(track_id, x, y): each track's polyline, with NaN where frames are missing."""
    step = F.transform("points", lambda p, i: F.when((i > 0) & (p["frame"] - F.get(F.col("points"), i - 1)["frame"] > 1), F.array(F.struct(F.lit(float("nan")).alias("x"), F.lit(float("nan")).alias("y")), F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return tracks.select("track_id", F.explode(F.flatten(step)).alias("p")).select("track_id", "p.x", "p.y")
