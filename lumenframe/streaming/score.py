"""Structured Streaming over the same Column expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.system import System, forward


def score(stream: DataFrame, system: System) -> DataFrame:
    """A stream with the expectations of the output units: projections only, so no state."""
    return forward(stream, system, prefix="expect ")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(user_id, start, stop, n) per session of a user."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def window_error(stream: DataFrame, system: System, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, error): mean squared residual of the system's outputs per window."""
    out = forward(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), system, prefix="~")
    square = sum((F.col(f"`{c}`") - F.col(f"`~{c}`")) * (F.col(f"`{c}`") - F.col(f"`~{c}`")) for c in system.layers[-1].columns)
    made = out.groupBy(F.window(time, width)).agg((F.avg(square) / len(system.layers[-1].columns)).alias("error"))
    return made.select(F.col("window.start").alias("start"), "error")
