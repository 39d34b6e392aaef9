"""Streaming forms: block summaries of a tick stream by time window, late ticks bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_blocks(ticks: DataFrame, width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """instrument_id, start, n, min_price, max_price, last_price of each window. ticks: instrument_id, ts_ns, price.

    Works on a batch too. State holds one row per instrument and open window."""
    timed = ticks.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns").cast("decimal(20,0)") / 1000).cast("long"))).withWatermark("ts", delay)
    return timed.groupBy("instrument_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.max_by("price", "ts_ns").alias("last_price")
    ).select("instrument_id", F.col("w.start").alias("start"), "n", "min_price", "max_price", "last_price")
