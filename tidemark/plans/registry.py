"""All queries of the engine by name over the supplied tables, and the same in SQL for DuckDB.

Ticks are events: the user is the instrument (or the event type, where a dense series is wanted), the value the price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import DAY_S, HOUR_NS, NS, epoch_ns
from tidemark.operators import calendar as cal
from tidemark.operators import extrema, rolling, strategy, summary
from tidemark.operators.asof import FORWARD, as_of, in_interval
from tidemark.operators.positions import price_positions
from tidemark.operators.snapshot import snapshot
from tidemark.sources.config import REGIONS
from tidemark.sources.store import verify

#: Settings of the registered queries.
STRIDE, WINDOW, ENTRY, EXIT, HOLD_S = 16, 20, 1.0, 0.0, 6 * 3600


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("instrument_id"), epoch_ns(F.col("ts")).alias("ts_ns"), F.col("value").cast("float").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("volume"), "event_id", "event_type")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by event type, a segment for each UTC day."""
    day = F.date_from_unix_date(F.floor(F.col("ts_ns").cast("decimal(20,0)") / (DAY_S * NS)).cast("int"))
    return ticks(spark, sf_dir).select(F.col("event_type").alias("series"), day.alias("day"), "ts_ns", "price")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", "instrument_id", (F.col("ts_ns") + (F.col("event_id") % 7 - 3) * 3600 * NS).alias("t_ns"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    entry = F.col("ts_ns") + (F.col("event_id") % 3 - 1) * 1800 * NS
    return t.select(F.col("event_id").alias("trade_id"), "instrument_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"), (1 + F.col("event_id") % 100).alias("quantity"), entry.alias("entry_ts_ns"), (entry + (F.col("event_id") % 72) * 3600 * NS).alias("exit_ts_ns"))


def regions(spark: SparkSession) -> DataFrame:
    import datetime as dt

    week, d = [1, 2, 3, 4, 5], dt.date
    return spark.createDataFrame(
        [
            (0, "West", 1000, -5 * 3600, -4 * 3600, d(2024, 1, 20), week, [d(2024, 1, 1), d(2024, 1, 15)], [(34_200, 57_600)]),
            (1, "Middle", 500, 3600, 7200, d(2024, 3, 31), week, [d(2024, 1, 1)], [(32_400, 63_000)]),
            (2, "East", 500, 9 * 3600, 9 * 3600, None, week, [d(2024, 1, 1), d(2024, 1, 8)], [(32_400, 41_400), (45_000, 54_000)]),
        ],
        REGIONS,
    )


def sessions(spark: SparkSession) -> DataFrame:
    return cal.calendar(regions(spark), "2024-01-01", "2024-01-31")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("instrument_id").distinct().withColumn("region_id", (F.col("instrument_id") % 3).cast("int"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.assign_segments(ticks(spark, sf_dir), ids(spark, sf_dir), sessions(spark))


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(probes(spark, sf_dir), ticks(spark, sf_dir), "t_ns")


def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(probes(spark, sf_dir), ticks(spark, sf_dir), "t_ns", FORWARD)


def asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(probes(spark, sf_dir), ticks(spark, sf_dir), "t_ns", bucket_ns=HOUR_NS)


def priced(spark: SparkSession, sf_dir: str, method: str = "blocks") -> DataFrame:
    got = price_positions(positions(spark, sf_dir), ticks(spark, sf_dir), method)
    return got.select("trade_id", "status", "entry_ts_ns", "exit_ts_ns", "entry_price", "exit_price", F.round("pnl", 4).alias("pnl"), F.round("max_adverse_excursion", 4).alias("mae"))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_positions(positions(spark, sf_dir), ticks(spark, sf_dir)).agg(F.sum("status").cast("long").alias("unresolved"), F.count(F.lit(1)).alias("positions"))


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extrema.block_index(ticks(spark, sf_dir), STRIDE)


def series_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


def snapshot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spark.range(31).select(F.col("id").alias("ordinal"), (F.lit(1_704_067_200 * NS + 43_200 * NS) + F.col("id") * (86_400 * NS)).alias("t_ns"))
    return snapshot(at, ticks(spark, sf_dir), ticks(spark, sf_dir))


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark).select("region_id", "region", F.date_format("day", "yyyyMMdd").alias("day"), "session", "start_ns", "end_ns")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.segments(assigned(spark, sf_dir)).select("instrument_id", "region_id", F.date_format("day", "yyyyMMdd").alias("day"), "session", "start_ns", "end_ns", "n", "first_ts", "last_ts")


def segment_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = cal.segments(assigned(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyyMMdd"))
    return in_interval(probes(spark, sf_dir), cuts, "t_ns", ("day", "session"))


def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rolling.rolling(series(spark, sf_dir), WINDOW, ("series", "day"))
    return got.select("series", "ts_ns", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("z", 5).alias("z"))


def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is put some hundred places later in the file than its time is."""
    late = (F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 400).otherwise(0)) * 10 + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    return rolling.not_increasing(ticks(spark, sf_dir).withColumn("seq", late), 1000).select("event_id", "instrument_id", "ts_ns", "before_ns")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.strategy(series(spark, sf_dir), WINDOW, ENTRY, EXIT, HOLD_S, ("series", "day"))


def strategy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).withColumn("pnl", F.round("pnl", 4)).drop("day")


def strategy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strategy.strategy_by_windows(series(spark, sf_dir), WINDOW, ENTRY, EXIT, HOLD_S, ("series", "day"))
    return got.withColumn("pnl", F.round("pnl", 4)).drop("day")


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, flag = (F.length("series") % 3).cast("int"), (F.length("series") % 2).cast("int")
    got = trades(spark, sf_dir).select(region.alias("region_id"), flag.alias("reverter_flag"), F.col("day").alias("exit_day"), "pnl")
    return got, series(spark, sf_dir).select(region.alias("region_id"), "day")


def daily_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, days = _grouped(spark, sf_dir)
    return summary.daily_pnl(got, days, regions(spark)).select("region", "reverter_flag", F.date_format("day", "yyyyMMdd").alias("day"), F.round("pnl", 3).alias("pnl"))


def strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, days = _grouped(spark, sf_dir)
    return summary.summarise(got, days, regions(spark)).select("region", "reverter_flag", "trade_count", F.round("total_pnl", 3).alias("total_pnl"), F.round("sharpe", 6).alias("sharpe"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = summary.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return got.withColumn("mean_value", F.round("mean_value", 6))


def store_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).drop("event_id", "event_type")
    changed = t.withColumn("volume", F.when(F.col("instrument_id") % 10 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return verify(t, changed).select("side", "instrument_id", "ts_ns", "price", "volume")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "asof_backward": asof_backward, "asof_forward": asof_forward, "asof_bucketed": asof_bucketed, "price_positions": priced,
    "mae_scan": lambda s, d: priced(s, d, "scan"), "unresolved_count": unresolved, "block_index": block_index, "series_counts": series_counts,
    "snapshot_grid": snapshot_grid, "calendar_days": calendar_days, "segments": segments, "segment_containing": segment_containing,
    "rolling_zscore": rolling_zscore, "monotonic_check": monotonic_check, "strategy_trades": strategy_trades, "strategy_windows": strategy_windows,
    "daily_pnl": daily_pnl, "strategy_summary": strategy_summary, "latency_percentiles": latency_percentiles, "store_verify": store_verify,
}

_TICKS = "t AS (SELECT user_id AS instrument_id, epoch_us(ts) * 1000 AS ts_ns, CAST(value AS FLOAT) AS price, CAST(json_extract_string(props, '$.k') AS INTEGER) AS volume, event_id, event_type FROM events)"
_PROBES = "p AS (SELECT event_id, instrument_id, ts_ns + (event_id % 7 - 3) * 3600000000000 AS t_ns FROM t)"
_ASOF = f"WITH {_TICKS}, {_PROBES} SELECT p.*, t.ts_ns, t.price FROM p ASOF LEFT JOIN t ON p.instrument_id = t.instrument_id AND p.t_ns @ t.ts_ns"
_PRICED = f"""WITH {_TICKS}, q AS (
  SELECT event_id AS trade_id, instrument_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, 1 + event_id % 100 AS quantity,
         ts_ns + (event_id % 3 - 1) * 1800000000000 AS t_in, ts_ns + (event_id % 3 - 1) * 1800000000000 + (event_id % 72) * 3600000000000 AS t_out
  FROM t
), a AS (SELECT q.*, t.ts_ns AS i_ns, t.price AS i_price FROM q ASOF LEFT JOIN t ON q.instrument_id = t.instrument_id AND q.t_in <= t.ts_ns),
b AS (SELECT a.*, t.ts_ns AS o_ns, t.price AS o_price FROM a ASOF LEFT JOIN t ON a.instrument_id = t.instrument_id AND a.t_out >= t.ts_ns),
c AS (SELECT *, CASE WHEN i_ns IS NULL OR o_ns IS NULL OR o_ns < i_ns THEN 1 ELSE 0 END AS status FROM b),
x AS (SELECT c.trade_id, min(t.price) AS lo, max(t.price) AS hi FROM c JOIN t ON c.instrument_id = t.instrument_id AND t.ts_ns BETWEEN c.i_ns AND c.o_ns WHERE status = 0 GROUP BY 1),
priced AS (SELECT c.trade_id, status, CASE WHEN status = 0 THEN i_ns END AS entry_ts_ns, CASE WHEN status = 0 THEN o_ns END AS exit_ts_ns,
  CASE WHEN status = 0 THEN i_price END AS entry_price, CASE WHEN status = 0 THEN o_price END AS exit_price,
  CASE WHEN status = 0 THEN round(side * quantity * (o_price::DOUBLE - i_price::DOUBLE), 4) + 0.0 END AS pnl,
  CASE WHEN status = 0 THEN round(greatest(0, CASE WHEN side > 0 THEN i_price::DOUBLE - lo::DOUBLE ELSE hi::DOUBLE - i_price::DOUBLE END) * quantity, 4) END AS mae
  FROM c LEFT JOIN x USING (trade_id))"""
_CALENDAR = """r AS (SELECT * FROM (VALUES
    (0, 'West', -18000, -14400, DATE '2024-01-20', [DATE '2024-01-01', DATE '2024-01-15'], [(0, 34200, 57600)]),
    (1, 'Middle', 3600, 7200, DATE '2024-03-31', [DATE '2024-01-01'], [(0, 32400, 63000)]),
    (2, 'East', 32400, 32400, NULL, [DATE '2024-01-01', DATE '2024-01-08'], [(0, 32400, 41400), (1, 45000, 54000)])) AS v(region_id, region, off, dst, dst_start, holidays, hours)),
d AS (SELECT r.*, CAST(g AS DATE) AS date FROM r, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS g)),
o AS (SELECT *, unnest(hours) AS h, CASE WHEN dst_start IS NOT NULL AND date >= dst_start THEN dst ELSE off END AS shift FROM d WHERE dayofweek(date) BETWEEN 1 AND 5 AND NOT list_contains(holidays, date)),
cal AS (SELECT region_id, region, strftime(date, '%Y%m%d') AS day, CAST(h[1] AS INTEGER) AS session,
  (epoch(date)::BIGINT + h[2] - shift) * 1000000000 AS start_ns, (epoch(date)::BIGINT + h[3] - shift) * 1000000000 AS end_ns FROM o)"""
_SEGMENTS = f"""{_TICKS}, {_CALENDAR}, seg AS (
  SELECT instrument_id, region_id, day, session, start_ns, end_ns, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts
  FROM t JOIN cal ON t.instrument_id % 3 = cal.region_id AND t.ts_ns >= start_ns AND t.ts_ns < end_ns GROUP BY ALL)"""
_ROLLING = f"""e AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, epoch_us(ts) * 1000 AS ts_ns, CAST(value AS FLOAT) AS price FROM events),
r1 AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY series, day) AS n, first_value(price::DOUBLE) OVER w AS base FROM e WINDOW w AS (PARTITION BY series, day ORDER BY ts_ns)),
r2 AS (SELECT *, price::DOUBLE - base AS x FROM r1),
r3 AS (SELECT *, sum(x) OVER w AS s1, sum(x * x) OVER w AS s2 FROM r2 WINDOW w AS (PARTITION BY series, day ORDER BY ts_ns ROWS UNBOUNDED PRECEDING)),
r4 AS (SELECT *, CASE WHEN pos >= {WINDOW} THEN (s1 - coalesce(lag(s1, {WINDOW}) OVER w, 0)) / {WINDOW} END AS m, CASE WHEN pos >= {WINDOW} THEN (s2 - coalesce(lag(s2, {WINDOW}) OVER w, 0)) / {WINDOW} END AS q FROM r3 WINDOW w AS (PARTITION BY series, day ORDER BY ts_ns)),
r5 AS (SELECT *, m + base AS mean, CASE WHEN m IS NOT NULL THEN greatest(q - m * m, 0) END AS variance FROM r4),
z AS (SELECT *, CASE WHEN variance > 1e-14 * base * base THEN (x - m) / sqrt(variance) END AS z FROM r5)"""
_TRADES = f"""RECURSIVE {_ROLLING},
f AS (SELECT *, min(CASE WHEN z >= {EXIT} THEN pos END) OVER later AS up, min(CASE WHEN z <= -{EXIT} THEN pos END) OVER later AS down,
  min(pos) OVER (PARTITION BY series, day ORDER BY ts_ns RANGE BETWEEN {HOLD_S * NS} FOLLOWING AND UNBOUNDED FOLLOWING) AS late,
  CASE WHEN price > 0 THEN CAST(floor(10000.0 / price::DOUBLE) AS BIGINT) ELSE 0 END AS quantity, CASE WHEN z > {ENTRY} THEN -1 WHEN z < -{ENTRY} THEN 1 END AS side
  FROM z WINDOW later AS (PARTITION BY series, day ORDER BY ts_ns ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT series, day, pos, side, quantity, ts_ns, price, least(coalesce(CASE WHEN side = 1 THEN up ELSE down END, n), coalesce(CASE WHEN late IS NOT NULL THEN greatest(late, pos + 1) END, n), n) AS xi FROM f WHERE side IS NOT NULL AND quantity >= 1 AND pos < n),
c AS (SELECT k.* FROM k JOIN (SELECT series, day, min(pos) AS pos FROM k GROUP BY ALL) USING (series, day, pos)
  UNION ALL SELECT nx.* FROM c, LATERAL (SELECT * FROM k WHERE k.series = c.series AND k.day = c.day AND k.pos > c.xi ORDER BY k.pos LIMIT 1) AS nx),
trades AS (SELECT c.series, c.day, CAST(c.side AS INTEGER) AS side, c.quantity, c.ts_ns AS entry_ts_ns, x.ts_ns AS exit_ts_ns, c.price AS entry_price, x.price AS exit_price,
  c.side * c.quantity * (x.price::DOUBLE - c.price::DOUBLE) AS pnl FROM c JOIN z AS x ON x.series = c.series AND x.day = c.day AND x.pos = c.xi)"""
_DAILY = f"""{_TRADES}, names AS (SELECT * FROM (VALUES (0, 'West'), (1, 'Middle'), (2, 'East')) AS v(region_id, region)),
cells AS (SELECT DISTINCT region_id, region, flag AS reverter_flag, day FROM names JOIN (SELECT DISTINCT length(series) % 3 AS region_id, day FROM e) USING (region_id), (VALUES (0), (1)) AS g(flag)),
sums AS (SELECT length(series) % 3 AS region_id, length(series) % 2 AS reverter_flag, day, sum(pnl) AS pnl FROM trades GROUP BY ALL),
daily AS (SELECT cells.*, coalesce(sums.pnl, 0) AS pnl FROM cells LEFT JOIN sums USING (region_id, reverter_flag, day))"""
_STRATEGY = f"WITH {_TRADES} SELECT series, side, quantity, entry_ts_ns, exit_ts_ns, entry_price, exit_price, round(pnl, 4) AS pnl FROM trades"

SQL: dict[str, str] = {
    "asof_backward": _ASOF.replace("@", ">="),
    "asof_forward": _ASOF.replace("@", "<="),
    "asof_bucketed": _ASOF.replace("@", ">="),
    "price_positions": f"{_PRICED} SELECT * FROM priced",
    "mae_scan": f"{_PRICED} SELECT * FROM priced",
    "unresolved_count": f"{_PRICED} SELECT CAST(sum(status) AS BIGINT) AS unresolved, count(*) AS positions FROM priced",
    "block_index": f"WITH {_TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns) - 1) // {STRIDE} AS block_no FROM t) SELECT instrument_id, block_no, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, min(price) AS min_price, max(price) AS max_price, count(*) AS n FROM n GROUP BY ALL",
    "series_counts": f"WITH {_TICKS} SELECT instrument_id, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM t GROUP BY ALL",
    "snapshot_grid": f"WITH {_TICKS}, g AS (SELECT i AS ordinal, 1704067200000000000 + i * 86400000000000 + 43200000000000 AS t_ns, instrument_id FROM range(31) AS r(i), (SELECT DISTINCT instrument_id FROM t)) SELECT g.ordinal, g.t_ns, g.instrument_id, t.price FROM g ASOF LEFT JOIN t ON g.instrument_id = t.instrument_id AND g.t_ns >= t.ts_ns",
    "calendar_days": f"WITH {_CALENDAR} SELECT * FROM cal",
    "segments": f"WITH {_SEGMENTS} SELECT * FROM seg",
    "segment_containing": f"WITH {_SEGMENTS}, {_PROBES} SELECT p.*, seg.day, seg.session FROM p LEFT JOIN seg ON p.instrument_id = seg.instrument_id AND p.t_ns >= start_ns AND p.t_ns < end_ns",
    "rolling_zscore": f"WITH {_ROLLING} SELECT series, ts_ns, pos, round(mean, 6) AS mean, round(variance, 4) AS variance, round(z, 5) AS z FROM z",
    "monotonic_check": f"WITH {_TICKS}, l AS (SELECT *, lag(ts_ns) OVER (PARTITION BY instrument_id ORDER BY (event_id + CASE WHEN event_id % 5 = 0 THEN 400 ELSE 0 END) * 10 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS before_ns FROM t) SELECT event_id, instrument_id, ts_ns, before_ns FROM l WHERE ts_ns <= before_ns",
    "strategy_trades": _STRATEGY,
    "strategy_windows": _STRATEGY,
    "daily_pnl": f"WITH {_DAILY} SELECT region, reverter_flag, strftime(day, '%Y%m%d') AS day, round(pnl, 3) AS pnl FROM daily",
    "strategy_summary": f"""WITH {_DAILY}, s AS (SELECT region_id, region, reverter_flag, CASE WHEN count(*) >= 2 AND stddev_samp(pnl) > 0 THEN round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) END AS sharpe FROM daily GROUP BY ALL),
grid AS (SELECT region_id, region, flag AS reverter_flag FROM names, (VALUES (0), (1)) AS g(flag)),
n AS (SELECT length(series) % 3 AS region_id, length(series) % 2 AS reverter_flag, count(*) AS trade_count, sum(pnl) AS total FROM trades GROUP BY ALL)
SELECT grid.region, grid.reverter_flag, coalesce(trade_count, 0) AS trade_count, round(coalesce(total, 0), 3) AS total_pnl, sharpe FROM grid LEFT JOIN n USING (region_id, reverter_flag) LEFT JOIN s USING (region_id, reverter_flag)""",
    "latency_percentiles": "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events",
    "store_verify": f"WITH {_TICKS}, a AS (SELECT instrument_id, ts_ns, price, volume FROM t), b AS (SELECT instrument_id, ts_ns, price, CASE WHEN instrument_id % 10 = 0 THEN volume + 1 ELSE volume END AS volume FROM t) SELECT 'raw' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'store', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
}
