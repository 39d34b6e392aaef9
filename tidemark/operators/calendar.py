"""Trading calendars: open sessions by region and day in UTC, and the segments of a series that they cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import DAY_S, NS, day_of_week, floor_div, local_to_utc


def is_trading_day(day: Column, weekdays: Column, holidays: Column) -> Column:
    """weekdays: array of 0 (Sunday) to 6; holidays: array of dates."""
    return F.array_contains(weekdays, day_of_week(day)) & ~F.coalesce(F.array_contains(holidays, day), F.lit(False))


def calendar(regions: DataFrame, start: str, end: str) -> DataFrame:
    """region_id, region, day, session, start_ns, end_ns (half open, UTC) of each open session from start to end, both in.

    regions: region_id, region, offset_s, dst_offset_s, dst_start (date or null), weekdays, holidays,
    sessions array<struct<start_s, end_s>> in local seconds."""
    days = regions.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    open_ = days.where(is_trading_day(F.col("day"), F.col("weekdays"), F.col("holidays")))
    cut = open_.select("*", F.posexplode("sessions").alias("session", "hours"))
    utc = lambda s: local_to_utc(F.unix_date("day").cast("long") * DAY_S + s, F.col("offset_s"), F.col("dst_offset_s"), F.col("dst_start")) * NS
    return cut.select("region_id", "region", "day", "session", utc(F.col("hours.start_s")).alias("start_ns"), utc(F.col("hours.end_s")).alias("end_ns"))


def instruments(regions: DataFrame, reverters: DataFrame | None = None) -> DataFrame:
    """instrument_id, region_id, is_reverter: ids are dealt to regions in list order, n_stocks to each."""
    upto = F.sum("n_stocks").over(Window.orderBy("region_id"))
    ranged = regions.select("region_id", "n_stocks", (upto - F.col("n_stocks")).alias("first"), upto.alias("upto")).where("n_stocks > 0")
    ids = ranged.select(F.explode(F.sequence("first", F.col("upto") - 1)).alias("instrument_id"), "region_id").withColumn("instrument_id", F.col("instrument_id").cast("long"))
    if reverters is None:
        return ids.withColumn("is_reverter", F.lit(0))
    flags = reverters.select(F.col("instrument_id").cast("long").alias("instrument_id")).distinct().withColumn("flag", F.lit(1))
    return ids.join(flags, "instrument_id", "left").select("instrument_id", "region_id", F.coalesce("flag", F.lit(0)).alias("is_reverter"))


def assign_segments(ticks: DataFrame, ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ticks with region_id, day, session, seg_start_ns and seg_end_ns; ticks outside all sessions are left out.

    Ticks meet sessions on region and UTC day (a session is listed under each day that it touches), a bounded number for
    each tick; Spark broadcasts the calendar if it is small."""
    by_day = sessions.withColumn("utc_day", F.explode(F.sequence(floor_div(F.col("start_ns"), DAY_S * NS), floor_div(F.col("end_ns") - 1, DAY_S * NS))))
    placed = ticks.join(ids.select("instrument_id", "region_id"), "instrument_id").withColumn("utc_day", floor_div(F.col("ts_ns"), DAY_S * NS))
    met = placed.join(by_day.withColumnsRenamed({"start_ns": "seg_start_ns", "end_ns": "seg_end_ns"}).drop("region"), ["region_id", "utc_day"])
    return met.where((F.col("ts_ns") >= F.col("seg_start_ns")) & (F.col("ts_ns") < F.col("seg_end_ns"))).drop("utc_day")


def segments(assigned: DataFrame) -> DataFrame:
    """instrument_id, region_id, day, session, start_ns, end_ns, n, first_ts, last_ts of sessions that have ticks."""
    return assigned.groupBy("instrument_id", "region_id", "day", "session", F.col("seg_start_ns").alias("start_ns"), F.col("seg_end_ns").alias("end_ns")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts")
    )
