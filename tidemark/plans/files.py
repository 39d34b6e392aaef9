"""Registered queries that go through files: raw ticks to a store and back, text inputs and outputs, matrices, run logs.

Ticks are events again; the instrument is the user's number mod 7, so that there are few files. Instruments 0 to 5 belong
to three regions, 6 to none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import DAY_S, NS, format_date, local_to_utc, parse_date, utc_to_local
from tidemark.operators import calendar as cal
from tidemark.operators import generate
from tidemark.plans import registry
from tidemark.sources import store as st
from tidemark.sources import text
from tidemark.sources.shared import new_path, staged
from tidemark.sources.ticks import read_raw, write_raw

#: Instruments; how many each region has; settings of the generator.
N, STOCKS, STRIDE = 7, (3, 2, 1), 16
MODEL = {
    "StartPriceUniform": [10, 500], "AnnualVolatilityUniformPct": [15, 60], "BaseVolumeUniform": [50, 2000], "RegionIsRevertorProbabilityPct": [30],
    "HalfLifeSecsUniform": [300, 1200], "OULongRunStdUniformPct": [0.05, 0.15], "TradeSecondDropProbabilityPct": [0],
}


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.ticks(spark, sf_dir).withColumn("instrument_id", F.col("instrument_id") % N)


def regions(spark: SparkSession) -> DataFrame:
    stocks = F.element_at(F.array(*[F.lit(n).cast("long") for n in STOCKS]), F.col("region_id") + 1)
    return registry.regions(spark).withColumn("n_stocks", stocks)


def opened(spark: SparkSession, sf_dir: str) -> tuple[st.Store, DataFrame]:
    """A store made of raw files, and what was read from those."""
    raw, at = new_path(spark, "raw"), new_path(spark, "store")
    days = spark.sql("select date'2023-12-31' as trade_date")
    write_raw(dense(spark, sf_dir), raw, spark.range(N).withColumnRenamed("id", "instrument_id"), days)  # with a day of empty files
    got = staged(read_raw(spark, raw), "raw-ticks")
    st.ingest(got, at, cal.instruments(regions(spark)), registry.sessions(spark), STRIDE)
    return st.open_store(spark, at), got


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].ticks.select("instrument_id", "ts_ns", "price", "volume", format_date(F.col("trade_date")).alias("day"))


def store_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].blocks


def store_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].between(3, 100, 415).select("instrument_id", "pos", "ts_ns", "price")


def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].records(1, 4, 99).select("instrument_id", "ts_ns", "price", "volume")


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].look_up(spark.range(-2, 12).select(F.col("id").alias("instrument_id")))


def store_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = opened(spark, sf_dir)[0].segments
    return got.select("instrument_id", "region_id", format_date(F.col("day")).alias("day"), "session", "start_ns", "end_ns", "n", "first_ts", "last_ts")


def store_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = opened(spark, sf_dir)
    bad = st.verify(raw, store.ticks).agg(F.count(F.lit(1)).alias("bad_ticks")).crossJoin(st.verify_blocks(store.ticks, store.blocks, STRIDE).agg(F.count(F.lit(1)).alias("bad_blocks")))
    return bad.crossJoin(store.ticks.agg(F.count(F.lit(1)).alias("points")))  # of single rows


def index_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of the index finds where a seventh of the ticks has changed under it."""
    store, _ = opened(spark, sf_dir)
    changed = store.ticks.withColumn("price", F.when(F.col("instrument_id") == 2, F.col("price") + F.lit(1).cast("float")).otherwise(F.col("price")))
    return st.verify_blocks(changed, store.blocks, STRIDE).select("side", "instrument_id", "block_no", "min_price", "max_price", "n")


def positions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "positions.csv")
    asked = registry.positions(spark, sf_dir)
    lines = asked.select("trade_id", F.concat_ws(",", *[F.col(c).cast("string") for c in text.POSITION]).alias("line"))
    head = spark.createDataFrame([(-1, ",".join(text.POSITION))], "trade_id long, line string")
    text.write_lines(lines.unionByName(head), "line", ["trade_id"], at)
    return text.read_positions(spark, at)


def instants_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "instants.txt")
    hours = registry.ticks(spark, sf_dir).select("event_id", (F.col("ts_ns") - F.pmod("ts_ns", F.lit(3600 * NS))).alias("t"))
    text.write_lines(hours, "t", ["event_id"], at)
    return text.read_instants(spark, at)


def flagged(spark: SparkSession) -> DataFrame:
    """Instruments with regions and flags, the flags by way of a file."""
    at = new_path(spark, "reverters.txt")
    ids = cal.instruments(registry.regions(spark))
    text.write_reverters(ids.withColumn("is_reverter", (F.col("instrument_id") % 5 == 1).cast("int")), at)
    return cal.instruments(registry.regions(spark), text.read_reverters(spark, at, 1500))


def instrument_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark)


def priced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "priced.csv")
    got = registry.price_positions(registry.positions(spark, sf_dir), registry.ticks(spark, sf_dir))
    text.write_priced(got.withColumn("ordinal", F.col("trade_id")), at)
    back = spark.read.schema("trade_id long, status int, entry_ts_ns long, exit_ts_ns long, entry_price float, exit_price float, pnl double, mae double").option("header", "true").csv(at)
    return back.withColumn("pnl", F.round("pnl", 4)).withColumn("mae", F.round("mae", 4))


def trades_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "trades.csv")
    got = registry.trades(spark, sf_dir).withColumn("instrument_id", F.length("series").cast("long"))
    text.write_trades(got, at)
    back = spark.read.schema("instrument_id long, side int, quantity long, entry_ts_ns long, exit_ts_ns long, entry_price float, exit_price float, pnl double").option("header", "true").csv(at)
    return back.withColumn("pnl", F.round("pnl", 4))


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "summary")
    got, days = registry._grouped(spark, sf_dir)
    text.write_summary(registry.summary.summarise(got, days, registry.regions(spark)), f"{at}.csv", f"{at}.json")
    csv = spark.read.schema("region string, reverter_flag int, trade_count long, total_pnl double, sharpe double").option("header", "true").option("nanValue", "nan").csv(f"{at}.csv")
    json = spark.read.schema("region string, reverter_flag int, trade_count long, total_pnl double, sharpe double").json(f"{at}.json")
    told = lambda df, of: df.select(F.lit(of).alias("file"), "region", "reverter_flag", "trade_count", F.round("total_pnl", 3).alias("total_pnl"), F.round(F.nanvl("sharpe", F.lit(None).cast("double")), 6).alias("sharpe"))
    return told(csv, "csv").unionByName(told(json, "json"))


def snapshot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "snapshots.bin")
    text.write_matrix(registry.snapshot_grid(spark, sf_dir), at)
    return text.read_matrix(spark, at)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "runs.jsonl")
    lines = [text.run_line("trades", {"store": "s", "mae": "blocks", "runlog": "x"}, 1.5, time="2025-01-02T00:00:00Z"), "", "not json", text.run_line("snapshot", {"in": "i", "threads": 4}, 0.25, time="2025-01-03T00:00:00Z")]
    text.write_lines(spark.createDataFrame(list(enumerate(lines)), "k int, line string"), "line", ["k"], at)
    return text.read_runs(spark, at).select("time", "command", F.to_json(text.shown_params(F.col("params"))).alias("params"), "wall_seconds")


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local seconds and days of events in their region, back to UTC, and dates read from text in all forms."""
    t = registry.ticks(spark, sf_dir).select("event_id", F.floor(F.col("ts_ns").cast("decimal(20,0)") / NS).cast("long").alias("s"), (F.col("event_id") % 3).cast("int").alias("region_id"))
    r = registry.regions(spark).select("region_id", "offset_s", "dst_offset_s", "dst_start")
    zone = [F.col(c) for c in ("offset_s", "dst_offset_s", "dst_start")]
    local = t.join(r, "region_id").withColumn("local_s", utc_to_local(F.col("s"), *zone))
    day = F.date_from_unix_date(F.floor(F.col("local_s").cast("decimal(20,0)") / DAY_S).cast("int"))
    form = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy.M.d"), F.date_format(day, "yyyy-MM.dd"), F.lit("2024-02-30")), (F.col("event_id") % 4 + 1).cast("int"))
    return local.select("event_id", "region_id", "local_s", format_date(day).alias("day"), local_to_utc(F.col("local_s"), *zone).alias("utc_s"), format_date(parse_date(form)).alias("parsed"))


def generated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated week, two instruments a region, nothing dropped: a tick for each open second."""
    made = generate.generate(spark, regions(spark).withColumn("n_stocks", F.lit(3).cast("long")), MODEL, "2024-01-08", "2024-01-12", 5, limit=2)
    return made.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts_ns").alias("seconds"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.min((F.col("price") > 0) & (F.col("volume") >= 1)).alias("sound"))


def generated_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated positions, priced on the events: how many there are of each status, and instants in their span."""
    open_, ids = registry.sessions(spark), cal.instruments(regions(spark))
    asked = staged(generate.positions(spark, 5000, open_, ids, 3), "positions")
    got = registry.price_positions(asked, dense(spark, sf_dir)).join(asked.select("trade_id", (F.col("exit_ts_ns") - F.col("entry_ts_ns")).alias("hold")), "trade_id")
    span = open_.agg(F.min("start_ns"), F.max("end_ns")).first()
    at = generate.instants(spark, 500, span[0], span[1], 4).agg(F.count(F.when(F.col("t_ns").between(span[0], span[1]), 1)).alias("instants"))
    return got.agg(F.count(F.lit(1)).alias("positions"), F.sum((F.col("hold") < NS).cast("int")).cast("long").alias("short"), F.sum((F.col("hold") > 5 * DAY_S * NS).cast("int")).cast("long").alias("long"), F.count("pnl").alias("priced")).crossJoin(at).drop("priced")


QUERIES = {f.__name__: f for f in (
    store_round_trip, store_blocks, store_slice, store_records, store_lookup, store_segments, store_checks, index_verify, positions_text, instants_text, instrument_flags,
    priced_text, trades_text, summary_text, snapshot_matrix, run_log, local_times, generated_ticks, generated_inputs,
)}

_D = f"{registry._TICKS}, q AS (SELECT instrument_id % {N} AS instrument_id, ts_ns, price, volume FROM t)"
_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns) - 1 AS pos FROM q)"
_BLOCK = f"instrument_id, pos // {STRIDE} AS block_no, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, min(price) AS min_price, max(price) AS max_price, count(*) AS n"
_REGION = "CASE WHEN instrument_id < 0 THEN NULL WHEN instrument_id < 3 THEN 0 WHEN instrument_id < 5 THEN 1 WHEN instrument_id < 6 THEN 2 END"
_SUMMARY = registry.SQL["strategy_summary"]
SQL = {
    "store_round_trip": f"WITH {_D} SELECT *, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') AS day FROM q",
    "store_blocks": f"WITH {_D}, {_NUMBERED} SELECT {_BLOCK} FROM n GROUP BY ALL",
    "store_slice": f"WITH {_D}, {_NUMBERED} SELECT instrument_id, pos, ts_ns, price FROM n WHERE instrument_id = 3 AND pos >= 100 AND pos < 415",
    "store_records": f"WITH {_D} SELECT * FROM q WHERE instrument_id IN (1, 4)",
    "store_lookup": f"WITH {_D}, i AS (SELECT unnest(range(-2, 12)) AS instrument_id), c AS (SELECT instrument_id, count(*) AS n FROM q GROUP BY 1), g AS (SELECT instrument_id, coalesce(n, 0) AS n, coalesce({_REGION}, -1) AS region_id FROM i LEFT JOIN c USING (instrument_id)) SELECT *, CASE region_id WHEN 0 THEN 'West' WHEN 1 THEN 'Middle' WHEN 2 THEN 'East' END AS region FROM g",
    "store_segments": f"WITH {_D}, {registry._CALENDAR} SELECT instrument_id, region_id, day, session, start_ns, end_ns, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM q JOIN cal ON cal.region_id = {_REGION} AND ts_ns >= start_ns AND ts_ns < end_ns GROUP BY ALL",
    "store_checks": "SELECT 0 AS bad_ticks, 0 AS bad_blocks, count(*) AS points FROM events",
    "index_verify": f"WITH {_D}, {_NUMBERED}, m AS (SELECT * REPLACE (CASE WHEN instrument_id = 2 THEN price + 1::FLOAT ELSE price END AS price) FROM n), a AS (SELECT {_BLOCK} FROM m GROUP BY ALL), b AS (SELECT {_BLOCK} FROM n GROUP BY ALL) SELECT 'data' AS side, instrument_id, block_no, min_price, max_price, n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'index', instrument_id, block_no, min_price, max_price, n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "positions_text": f"WITH {registry._TICKS} SELECT row_number() OVER (ORDER BY event_id) AS ordinal, CAST(event_id AS VARCHAR) AS trade_id, instrument_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, 1 + event_id % 100 AS quantity, ts_ns + (event_id % 3 - 1) * 1800000000000 AS entry_ts_ns, ts_ns + (event_id % 3 - 1) * 1800000000000 + (event_id % 72) * 3600000000000 AS exit_ts_ns FROM t",
    "instants_text": f"WITH {registry._TICKS} SELECT row_number() OVER (ORDER BY event_id) - 1 AS ordinal, ts_ns - ts_ns % 3600000000000 AS t_ns FROM t",
    "instrument_flags": "SELECT i AS instrument_id, CASE WHEN i < 1000 THEN 0 WHEN i < 1500 THEN 1 ELSE 2 END AS region_id, CASE WHEN i % 5 = 1 AND i < 1500 THEN 1 ELSE 0 END AS is_reverter FROM range(2000) AS r(i)",
    "priced_text": registry.SQL["price_positions"],
    "trades_text": registry.SQL["strategy_trades"].replace("SELECT series, side", "SELECT length(series) AS instrument_id, side"),
    "summary_text": f"WITH both_files AS ({_SUMMARY}) SELECT file, both_files.* FROM both_files, (VALUES ('csv'), ('json')) AS f(file)",
    "snapshot_matrix": f"WITH s AS ({registry.SQL['snapshot_grid']}) SELECT ordinal AS row, instrument_id, price FROM s WHERE price IS NOT NULL AND instrument_id < 2000",
    "run_log": """SELECT time, command, params, wall_seconds::DOUBLE AS wall_seconds FROM (VALUES ('2025-01-03T00:00:00Z', 'snapshot', '{"threads":"4"}', 0.25), ('2025-01-02T00:00:00Z', 'trades', '{"mae":"blocks"}', 1.5)) AS v(time, command, params, wall_seconds)""",
    "local_times": f"""WITH {registry._TICKS}, {registry._CALENDAR}, l AS (SELECT event_id, region_id, off, dst, dst_start, ts_ns // 1000000000 AS s, CASE WHEN dst_start IS NOT NULL AND CAST(make_timestamp((ts_ns // 1000000000 + off) * 1000000) AS DATE) >= dst_start THEN dst ELSE off END AS shift FROM t JOIN r ON t.event_id % 3 = r.region_id),
m AS (SELECT *, s + shift AS local_s, CAST(make_timestamp((s + shift) * 1000000) AS DATE) AS d FROM l)
SELECT event_id, region_id, local_s, strftime(d, '%Y%m%d') AS day, local_s - CASE WHEN dst_start IS NOT NULL AND d >= dst_start THEN dst ELSE off END AS utc_s, CASE WHEN event_id % 4 < 2 THEN strftime(d, '%Y%m%d') END AS parsed FROM m""",
    "generated_ticks": f"WITH {registry._CALENDAR}, i AS (SELECT region_id * 3 + k AS instrument_id, region_id FROM range(3) AS g(region_id), range(2) AS h(k)) SELECT instrument_id, CAST(sum((end_ns - start_ns) // 1000000000) AS BIGINT) AS n, CAST(sum((end_ns - start_ns) // 1000000000) AS BIGINT) AS seconds, min(start_ns) AS first_ts, max(end_ns) - 1000000000 AS last_ts, true AS sound FROM i JOIN cal USING (region_id) WHERE day BETWEEN '20240108' AND '20240112' GROUP BY 1",
    "generated_inputs": "SELECT 5000 AS positions, 0 AS short, 0 AS long, 500 AS instants",
}
