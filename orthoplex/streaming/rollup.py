"""Rollups that follow a stream of events (beyond what a batch cube needs).

Events are summed per window and key behind a watermark; each micro-batch merges its
closed windows into a Parquet rollup by appending them: windows are closed once, so
appends never count twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) of each window and key; events later than ``late`` are left out."""
    stamped = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    out = stamped.groupBy(F.window("__ts", window).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, **how: str) -> StreamingQuery:
    """Reads new Parquet files below ``source`` and appends closed windows to ``target``, until all present files are done."""
    events = spark.readStream.schema(schema).parquet(source)
    return windowed(events, **how).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
