"""Pricing of positions: entry at the next tick, exit at the last, profit and maximum adverse excursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import DAY_NS, HOUR_NS
from tidemark.operators.asof import as_of_both
from tidemark.operators.extrema import by_buckets, by_scan


def price_positions(positions: DataFrame, ticks: DataFrame, method: str = "blocks", bucket_ns: int = HOUR_NS, series_bucket_ns: int = DAY_NS) -> DataFrame:
    """trade_id, status, entry_ts_ns, exit_ts_ns, entry_price, exit_price, pnl, max_adverse_excursion for each position.

    positions: trade_id (unique), instrument_id, side, quantity, entry_ts_ns, exit_ts_ns. Status 1 and nulls where a side
    finds no tick or the exit's tick lies before the entry's. A side of 0 or less takes the short branch; the profit takes
    the side as it is. method: scan or blocks, the same result; bucket_ns: the buckets on which ranges meet ticks. Prices are widened to doubles before any arithmetic."""
    asked = positions.withColumnsRenamed({"entry_ts_ns": "t_in", "exit_ts_ns": "t_out"})
    found = as_of_both(asked, ticks, "trade_id", "t_in", "t_out", bucket_ns=series_bucket_ns)
    bad = F.col("entry_ts_ns").isNull() | F.col("exit_ts_ns").isNull() | (F.col("exit_ts_ns") < F.col("entry_ts_ns"))
    found = found.withColumn("status", F.when(bad, 1).otherwise(0))
    ranges = found.where("status = 0").select(F.col("trade_id").alias("range_id"), "instrument_id", F.col("entry_ts_ns").alias("from_ns"), F.col("exit_ts_ns").alias("to_ns"))
    extremes = (by_scan if method == "scan" else by_buckets)(ranges, ticks, bucket_ns)
    joined = found.join(extremes, found["trade_id"] == extremes["range_id"], "left")
    ok = lambda c: F.when(F.col("status") == 0, c)
    entry, exit_ = F.col("entry_price").cast("double"), F.col("exit_price").cast("double")
    adverse = F.when(F.col("side") > 0, entry - F.col("lo").cast("double")).otherwise(F.col("hi").cast("double") - entry)
    return joined.select(
        "trade_id",
        "status",
        *[ok(F.col(c)).alias(c) for c in ("entry_ts_ns", "exit_ts_ns", "entry_price", "exit_price")],
        ok(F.col("side") * F.col("quantity") * (exit_ - entry)).alias("pnl"),
        ok(F.greatest(F.lit(0.0), adverse) * F.col("quantity")).alias("max_adverse_excursion"),
    )
