"""Last known price of every instrument at given instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import DAY_NS
from tidemark.operators.asof import as_of


def snapshot(instants: DataFrame, instruments: DataFrame, ticks: DataFrame, bucket_ns: int = DAY_NS) -> DataFrame:
    """ordinal, t_ns, instrument_id, price (null where none is known) for each instant and instrument.

    instants: ordinal, t_ns, duplicates allowed. The grid is the answer's own size; prices carry over nights and weekends."""
    grid = instants.select("ordinal", "t_ns").crossJoin(instruments.select("instrument_id").distinct())
    return as_of(grid, ticks, "t_ns", bucket_ns=bucket_ns).select("ordinal", "t_ns", "instrument_id", "price")
