"""Writing sessions and frames: batches may come again, and each frame is there once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["session_id", "chunk_index"]
SESSION = "session_id string, created_at timestamp, device_info map<string,string>, status string, total_frames long, total_chunks long"


def known_frames(spark: SparkSession, path: str, schema) -> DataFrame:
    """The frames under ``path``; none where nothing was written yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def save_frames(batch: DataFrame, path: str, order: str) -> None:
    """Add frames (session_id, chunk_index, frame_index, ...) to the table under ``path``, partitioned by session and chunk.

    Only the partitions of the batch's chunks are rewritten: what they hold and the batch, with of each frame the last in
    ``order``.  So a batch that comes again, whole or in part, changes nothing, and one that died is made good by its repetition.
    Frames without a session, chunk or index can't be placed and are left out.  The rows go through a folder beside the table, as a
    table can't be read and overwritten at once.
    """
    spark = batch.sparkSession
    rows = batch.dropna(subset=[*KEY, "frame_index"])
    touched = rows.select(*KEY).distinct()
    before = known_frames(spark, path, rows.schema).join(touched, KEY, "left_semi")
    last = Window.partitionBy(*KEY, "frame_index").orderBy(F.desc(order))
    merged = before.unionByName(rows).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    beside = f"{path.rstrip('/')}_merging"
    merged.write.mode("overwrite").parquet(beside)
    out = spark.read.schema(merged.schema).parquet(beside).repartition(*KEY)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(path)


def frame_sink(path: str, order: str):
    """For ``writeStream.foreachBatch``: each micro-batch through ``save_frames``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        save_frames(batch, path, order)

    return save


def created_sessions(requests: DataFrame) -> DataFrame:
    """Rows of new sessions from requests (session_id, created_at, device_info): scanning, and nothing in them yet; a session
    asked for twice is made once, as it was first."""
    first = F.min_by(F.struct("created_at", "device_info"), "created_at").alias("_f")
    rows = requests.dropna(subset=["session_id"]).groupBy("session_id").agg(first)
    zero = F.lit(0).cast("long")
    return rows.select("session_id", "_f.created_at", "_f.device_info", F.lit("scanning").alias("status"), zero.alias("total_frames"), zero.alias("total_chunks"))


def session_totals(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the totals that their saved frames give: frames, and one more than the last chunk."""
    n = frames.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), (F.max("chunk_index") + 1).cast("long").alias("_c"))
    return sessions.join(n, "session_id", "left").withColumns({"total_frames": F.coalesce("_n", "total_frames"), "total_chunks": F.coalesce("_c", "total_chunks")}).drop("_n", "_c")
