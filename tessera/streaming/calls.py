"""Call statistics as a stream: event time, watermark, sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling(calls: DataFrame, window: str = "600 seconds", slide: str = "60 seconds", late: str = "600 seconds") -> DataFrame:
    """procedure, start, n, mean_latency, max_latency of each window; rows later than the watermark are left out, so state
    is bounded by the windows that are still open."""
    by = calls.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "procedure")
    return by.agg(F.count("*").alias("n"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency")).select("procedure", F.col("w.start").alias("start"), "n", "mean_latency", "max_latency")


def run(stream: DataFrame, where: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream's finished windows as Parquet, once each; the checkpoint lets a restart go on."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(where)
