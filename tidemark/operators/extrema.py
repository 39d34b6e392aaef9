"""Lowest and highest price over time ranges, by scanning the ticks or by summaries at several widths (zone maps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import DAY_NS, HOUR_NS, floor_div

#: Ticks a block summarises.
STRIDE = 256
#: Buckets of a level that make one of the next.
FACTORS = (24, 32)


def numbered(ticks: DataFrame, stride: int = STRIDE, bucket_ns: int = DAY_NS) -> DataFrame:
    """Ticks with pos, their place in the instrument's series from 0, and block_no. Places are counted within time buckets
    and begin after the counts of the buckets before, so no task sees a whole series."""
    cut = ticks.withColumn("__b", floor_div(F.col("ts_ns"), bucket_ns))
    sums = cut.groupBy("instrument_id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("instrument_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("instrument_id", "__b", (F.sum("__n").over(upto) - F.col("__n")).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("instrument_id", "__b").orderBy("ts_ns")) - 1
    placed = cut.join(sums, ["instrument_id", "__b"]).withColumn("pos", (F.col("__base") + inside).cast("long"))
    return placed.withColumn("block_no", F.floor(F.col("pos") / stride).cast("long")).select(*ticks.columns, "pos", "block_no")


def block_index(ticks: DataFrame, stride: int = STRIDE) -> DataFrame:
    """instrument_id, block_no, first_ts, last_ts, min_price, max_price, n; the last block of a series may be short."""
    return numbered(ticks, stride).groupBy("instrument_id", "block_no").agg(
        F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count(F.lit(1)).alias("n")
    )


def by_scan(ranges: DataFrame, ticks: DataFrame, bucket_ns: int = HOUR_NS) -> DataFrame:
    """range_id, lo, hi over [from_ns, to_ns], both ends in. ranges: range_id, instrument_id, from_ns, to_ns.

    Ranges meet ticks on (instrument, time bucket), not on the instrument alone, so a long series doesn't multiply."""
    cells = ranges.withColumn("b", F.explode(F.sequence(floor_div(F.col("from_ns"), bucket_ns), floor_div(F.col("to_ns"), bucket_ns))))
    dated = ticks.select("instrument_id", "ts_ns", "price", floor_div(F.col("ts_ns"), bucket_ns).alias("b"))
    inside = cells.join(dated, ["instrument_id", "b"]).where(F.col("ts_ns").between(F.col("from_ns"), F.col("to_ns")))
    return inside.groupBy("range_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))


def _cells(first: Column, last: Column, level: int) -> Column:
    """An array of (level, b) with each bucket from first to last; empty if there is none."""
    none = F.expr("cast(array() as array<bigint>)")
    return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(none), lambda b: F.struct(F.lit(level).alias("level"), b.alias("b")))


def by_buckets(ranges: DataFrame, ticks: DataFrame, bucket_ns: int = HOUR_NS, factors: tuple[int, ...] = FACTORS) -> DataFrame:
    """The same from summaries of time buckets of several widths, each rolled up from the one below: a range is cut into the
    widest whole buckets that fit, at most some dozens of each width below the widest, and only the ticks of the two
    buckets at its ends are scanned. Widths: bucket_ns, and bucket_ns times the factors in turn."""
    first, last = floor_div(F.col("from_ns"), bucket_ns), floor_div(F.col("to_ns"), bucket_ns)
    dated = ticks.select("instrument_id", "ts_ns", "price", floor_div(F.col("ts_ns"), bucket_ns).alias("b"))
    zone = dated.groupBy("instrument_id", "b").agg(F.min("price").alias("lo"), F.max("price").alias("hi")).withColumn("level", F.lit(0))
    zones = zone
    for level, factor in enumerate(factors, 1):
        zone = zone.groupBy("instrument_id", floor_div(F.col("b"), factor).alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("level", F.lit(level))
        zones = zones.unionByName(zone)
    inner = ranges.withColumn("f0", first + 1).withColumn("l0", last - 1).where("f0 <= l0")
    cells = []
    for level, factor in enumerate(factors):
        f, z = F.col(f"f{level}"), F.col(f"l{level}")
        up, down = floor_div(f + (factor - 1), factor), floor_div(z + 1, factor) - 1
        inner = inner.withColumn(f"f{level + 1}", up).withColumn(f"l{level + 1}", down)
        up, down = F.col(f"f{level + 1}"), F.col(f"l{level + 1}")
        whole = up <= down
        cells.append(_cells(f, F.when(whole, up * factor - 1).otherwise(z), level))
        cells.append(_cells(F.when(whole, (down + 1) * factor).otherwise(z + 1), z, level))
    top = len(factors)
    cells.append(_cells(F.col(f"f{top}"), F.col(f"l{top}"), top))
    met = inner.select("range_id", "instrument_id", F.explode(F.concat(*cells)).alias("c")).select("range_id", "instrument_id", "c.level", "c.b")
    whole = met.join(zones, ["instrument_id", "level", "b"]).select("range_id", "lo", "hi")
    ends = ranges.withColumn("b", F.explode(F.array_distinct(F.array(first, last))))
    edge = ends.join(dated, ["instrument_id", "b"]).where(F.col("ts_ns").between(F.col("from_ns"), F.col("to_ns"))).select("range_id", F.col("price").alias("lo"), F.col("price").alias("hi"))
    return whole.unionByName(edge).groupBy("range_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
