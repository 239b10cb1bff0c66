"""Frame ingest as a stream: at-least-once chunks, duplicates dropped, quiet sessions closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """Frames of chunk files (JSON arrays) as they arrive; files that don't parse give no rows."""
    return spark.readStream.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_trigger).json(path)


def deduplicated(frames: DataFrame, event_time: str, lateness: str = "10 minutes") -> DataFrame:
    """One row for each (session_id, frame_index) although clients retry; state is dropped behind the watermark."""
    return frames.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["session_id", "frame_index"])


def closed_sessions(frames: DataFrame, event_time: str, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Sessions that fell quiet for ``gap``: frames and chunks of each."""
    w = F.session_window(event_time, gap)
    return frames.withWatermark(event_time, lateness).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("total_frames"), (F.max("chunk_index") + 1).alias("total_chunks"))
