"""Rolling statistics over recorded prices, and checks of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import floor_div

#: Least variance, as a share of the squared first price, for which a z-score is a signal.
FLOOR = 1e-14


def rolling(ticks: DataFrame, window: int, by: tuple[str, ...]) -> DataFrame:
    """Ticks with pos (from 1), n_in_segment, mean, variance and z over the last `window` prices of the group `by`.

    Null until the window is full; z is null where the variance is no signal. Prefix sums of prices less the group's first
    one: each row costs the same whatever the window, and the shift keeps the sums exact where prices are alike."""
    group = Window.partitionBy(*by).orderBy("ts_ns")
    sofar = group.rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("price").over(sofar).cast("double")
    shifted = ticks.select("*", base.alias("base"), (F.col("price").cast("double") - base).alias("x"), F.row_number().over(group).alias("pos"))
    sums = shifted.select("*", F.sum("x").over(sofar).alias("s1"), F.sum(F.col("x") * F.col("x")).over(sofar).alias("s2"))
    less = lambda c: F.col(c) - F.coalesce(F.lag(c, window).over(group), F.lit(0.0))
    full = F.col("pos") >= window
    moments = sums.select("*", F.when(full, less("s1") / window).alias("m"), F.when(full, less("s2") / window).alias("q"))
    out = moments.withColumn("variance", F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).withColumn("variance", F.when(full, F.col("variance")))
    signal = F.col("variance") > FLOOR * F.col("base") * F.col("base")
    out = out.withColumn("z", F.when(signal, (F.col("x") - F.col("m")) / F.sqrt("variance"))).withColumn("mean", F.col("m") + F.col("base"))
    return out.drop("x", "s1", "s2", "m", "q")


def not_increasing(ticks: DataFrame, part: int = 10_000_000) -> DataFrame:
    """Ticks that don't lie strictly after the one before in file order (columns instrument_id, ts_ns, and seq for it), with
    before_ns. A series is taken in parts of that many numbers, a raw day file each; a part's first tick is held against
    the last of the part before."""
    cut = ticks.withColumn("__p", floor_div(F.col("seq"), part))
    ends = cut.groupBy("instrument_id", "__p").agg(F.max_by("ts_ns", "seq").alias("__last"))
    ends = ends.select("instrument_id", "__p", F.lag("__last").over(Window.partitionBy("instrument_id").orderBy("__p")).alias("__last"))
    before = F.lag("ts_ns").over(Window.partitionBy("instrument_id", "__p").orderBy("seq"))
    told = cut.join(ends, ["instrument_id", "__p"]).withColumn("before_ns", F.coalesce(before, "__last"))
    return told.where(F.col("ts_ns") <= F.col("before_ns")).select(*ticks.columns, "before_ns")
