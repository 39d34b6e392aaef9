"""As-of joins: the last tick at or before, or the first at or after, an instant.

Probes and ticks of an instrument are laid in one order, ticks before probes at equal times, and each probe takes the
latest non-null tick so far: one exchange, one sort, no join of the two. A series is also cut by time, so that one long or
hot series is many tasks; a small table carries each bucket's last tick forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import DAY_NS, floor_div

BACKWARD, FORWARD = "backward", "forward"


def _carried(rows: DataFrame, sign: int) -> Column:
    """The latest tick so far in the order of time (sign 1) or against it (sign -1) within (__i, __b); where there
    is none, what the buckets before had (column __before or __after)."""
    order = Window.partitionBy("__i", "__b").orderBy(*([F.col("__t"), F.col("__tag")] if sign > 0 else [F.desc("__t"), F.desc("__tag")]))
    hit = F.last("__tick", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(hit, F.col("__before" if sign > 0 else "__after"))


def _ends(rows: DataFrame) -> DataFrame:
    """__i, __b, __before, __after: the last tick before and the first after each bucket."""
    at = F.when(F.col("__tag") == 0, F.col("__t"))
    ends = rows.groupBy("__i", "__b").agg(F.max_by("__tick", at).alias("__last"), F.min_by("__tick", at).alias("__first"))
    order = Window.partitionBy("__i")
    before = order.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    after = order.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("__i", "__b", F.last("__last", ignorenulls=True).over(before).alias("__before"), F.last("__first", ignorenulls=True).over(after).alias("__after"))


def _laid(ticks: DataFrame, probes: list[tuple[DataFrame, str, int]], values: tuple[str, ...], bucket_ns: int) -> DataFrame:
    """__i (the instrument, a number of its own for null), __t, __tag, __tick, __row, __b, __before, __after. probes: (rows,
    instant, tag): 1 to come after a tick of the same time, -1 before; a tick has 0."""
    tick = F.struct("ts_ns", *values)
    kind = ticks.select(tick.alias("x")).schema["x"].dataType
    name = F.coalesce(F.col("instrument_id").cast("long"), F.lit(-(1 << 63)))
    rows = None
    for df, at, tag in probes:
        p = df.select(name.alias("__i"), F.col(at).alias("__t"), F.lit(tag).alias("__tag"), F.lit(None).cast(kind).alias("__tick"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
        rows = p if rows is None else rows.unionByName(p)
    known = ticks.where(F.col("instrument_id").isNotNull() & F.col("ts_ns").isNotNull())
    t = known.select(name.alias("__i"), F.col("ts_ns").alias("__t"), F.lit(0).alias("__tag"), tick.alias("__tick"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    rows = t.unionByName(rows).withColumn("__b", F.coalesce(floor_div(F.col("__t"), bucket_ns), F.lit(0)))
    return rows.join(_ends(rows), ["__i", "__b"])


def as_of(probes: DataFrame, ticks: DataFrame, at: str, direction: str = BACKWARD, values: tuple[str, ...] = ("price",), prefix: str = "", bucket_ns: int = DAY_NS) -> DataFrame:
    """Probes with {prefix}ts_ns and {prefix}value columns of the tick that matches; null where none does.

    probes: instrument_id, a BIGINT column named by `at`, any others; ticks: instrument_id, ts_ns, values; (instrument_id,
    ts_ns) is unique. Both directions are inclusive. Null instants and unknown instruments match nothing."""
    sign = 1 if direction == BACKWARD else -1
    rows = _laid(ticks, [(probes, at, sign)], values, bucket_ns)
    found = rows.withColumn("__hit", _carried(rows, sign)).where("__tag <> 0")
    return found.select("__row.*", *_told(F.when(F.col("__t").isNotNull(), F.col("__hit")), values, prefix))


def _told(hit: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    return [hit["ts_ns"].alias(f"{prefix}ts_ns"), *[hit[v].alias(f"{prefix}{v}") for v in values]]


def as_of_both(probes: DataFrame, ticks: DataFrame, key: str, forward: str, backward: str, values: tuple[str, ...] = ("price",), prefixes: tuple[str, str] = ("entry_", "exit_"), bucket_ns: int = DAY_NS) -> DataFrame:
    """as_of forward from one instant and backward from another of each probe, from one exchange of the ticks. key: a unique
    column of probes, on which the two answers meet."""
    rows = _laid(ticks, [(probes, forward, -1), (probes, backward, 1)], values, bucket_ns)
    hit = F.when(F.col("__tag") < 0, _carried(rows, -1)).when(F.col("__tag") > 0, _carried(rows, 1))
    found = rows.withColumn("__hit", hit).where("__tag <> 0").withColumn("__hit", F.when(F.col("__t").isNotNull(), F.col("__hit")))
    pick = lambda tag: F.max_by("__hit", F.when((F.col("__tag") == tag) & F.col("__hit").isNotNull(), F.lit(1)))
    met = found.groupBy(F.col(f"__row.{key}").alias("__key")).agg(F.first("__row").alias("__row"), pick(-1).alias("__f"), pick(1).alias("__b"))
    return met.select("__row.*", *_told(F.col("__f"), values, prefixes[0]), *_told(F.col("__b"), values, prefixes[1]))


def last_known(probes: DataFrame, ticks: DataFrame, at: str = "t_ns") -> DataFrame:
    """Last price at or before each probe."""
    return as_of(probes, ticks, at)


def in_interval(probes: DataFrame, intervals: DataFrame, at: str, values: tuple[str, ...], bucket_ns: int = 32 * DAY_NS) -> DataFrame:
    """Probes with values of the disjoint half-open interval [start_ns, end_ns) of their instrument that holds them; null
    in gaps. It is an as-of join on starts and a look at the end."""
    starts = intervals.select("instrument_id", F.col("start_ns").alias("ts_ns"), "end_ns", *values)
    found = as_of(probes, starts, at, values=("end_ns", *values), prefix="__", bucket_ns=bucket_ns)
    inside = F.col(at) < F.col("__end_ns")
    return found.select(*probes.columns, *[F.when(inside, F.col(f"__{v}")).alias(v) for v in values])
