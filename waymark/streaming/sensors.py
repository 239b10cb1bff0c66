"""Sensor samples matched to frames while both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of sensor, the greatest distance in time of a match, and how long samples wait for their frames.
KINDS = ("accel", "gyro", "magnet")
TOLERANCE_MS, AGE = 50, "5 seconds"


def matched(frames: DataFrame, samples: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """frame_id, frame_time, session_id and for each kind of sensor a struct (x, y, z, dt_ms) of the nearest sample of the
    session within ``tolerance_ms``, null without one; of equally near samples the earlier, then the one of least id.

    ``frames``: session_id, frame_id, frame_time; ``samples``: session_id, sample_id, type, sample_time, x, y, z.  The same plan
    serves tables and streams: a join on the session within a range of time, then one group for each frame.
    """
    s = samples.where(F.col("type").isin(*KINDS)).select(F.col("session_id").alias("_s"), "sample_id", "type", "sample_time", "x", "y", "z")
    reach = F.expr(f"interval {tolerance_ms} milliseconds")
    near = (F.col("session_id") == F.col("_s")) & (F.col("sample_time") >= F.col("frame_time") - reach) & (F.col("sample_time") <= F.col("frame_time") + reach)
    rows = frames.select("session_id", "frame_id", "frame_time").join(s, near, "leftOuter")
    dt = F.abs(F.unix_micros("sample_time") - F.unix_micros("frame_time"))
    value = F.struct("x", "y", "z", F.call_function("div", dt, F.lit(1000)).alias("dt_ms"))
    best = lambda kind: F.min_by(value, F.when(F.col("type") == kind, F.struct(dt.alias("d"), "sample_time", "sample_id"))).alias(kind)
    return rows.groupBy("session_id", "frame_id", "frame_time").agg(*[best(k) for k in KINDS])


def matched_stream(frames: DataFrame, samples: DataFrame, tolerance_ms: int = TOLERANCE_MS, age: str = AGE) -> DataFrame:
    """``matched`` over two streams: samples and frames that are ``age`` behind the newest are let go, so what is held is what
    came within that time and not the session.  A frame is answered once nothing can change its answer."""
    return matched(frames.withWatermark("frame_time", age), samples.withWatermark("sample_time", age), tolerance_ms)
