"""Time as columns: nanoseconds since the epoch (BIGINT), civil days and a region's local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
DAY_S = 86_400
HOUR_NS, DAY_NS = 3600 * NS, DAY_S * NS


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * F.lit(1000)


def _div(a: Column, b: Column) -> Column:
    return F.floor(a.cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Floor of a / b for BIGINT a of any sign, without a detour over doubles."""
    return _div(a - F.pmod(a, F.lit(b)), F.lit(b).cast("long"))


def day_of_week(day: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(day) - 1


def parse_date(text: Column) -> Column:
    """Y-M-D or Y.M.D with one kind of separator; null if there is no such day."""
    dash = F.when(text.rlike(r"^\d+-\d+-\d+$"), F.try_to_date(text, "y-M-d"))
    return dash.when(text.rlike(r"^\d+\.\d+\.\d+$"), F.try_to_date(text, "y.M.d"))


def format_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def local_to_utc(local_s: Column, offset_s: Column, dst_offset_s: Column, dst_start: Column) -> Column:
    """UTC seconds of local ones; daylight saving holds from its start day on (a null start: never)."""
    dst = F.coalesce(day_of(local_s) >= dst_start, F.lit(False))
    return local_s - F.when(dst, dst_offset_s).otherwise(offset_s)


def utc_to_local(utc_s: Column, offset_s: Column, dst_offset_s: Column, dst_start: Column) -> Column:
    """Local seconds of UTC ones; the day is judged with the standard offset."""
    dst = F.coalesce(day_of(utc_s + offset_s) >= dst_start, F.lit(False))
    return utc_s + F.when(dst, dst_offset_s).otherwise(offset_s)


def day_of(seconds: Column) -> Column:
    return F.date_from_unix_date(floor_div(seconds.cast("long"), DAY_S).cast("int"))
