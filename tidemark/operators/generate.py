"""Synthetic second-resolution ticks: a random walk for each instrument, a mean-reverting part for some, overnight jumps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import NS
from tidemark.operators.calendar import calendar, instruments

#: Fixed values of the model: trading seconds and days of a year, share of a day's move that falls overnight.
YEAR_SECONDS, YEAR_DAYS, OVERNIGHT = 5_896_800, 252, 0.5


def draw_instruments(ids: DataFrame, model: dict[str, list[float]], seed: int) -> DataFrame:
    """ids with start price, volatilities, base volume and reversion of each, from columns seeded by instrument."""
    u = lambda k: (F.pmod(F.xxhash64("instrument_id", F.lit(seed), F.lit(k)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    between = lambda k, name: u(k) * (model[name][1] - model[name][0]) + model[name][0]
    return ids.select(
        "instrument_id", "region_id",
        F.log(between(1, "StartPriceUniform")).alias("log_start"),
        (between(2, "AnnualVolatilityUniformPct") / 100).alias("annual_vol"),
        between(3, "BaseVolumeUniform").alias("volume"),
        (u(4) < model["RegionIsRevertorProbabilityPct"][0] / 100).alias("is_reverter"),
        between(5, "HalfLifeSecsUniform").alias("half_life"),
        (between(6, "OULongRunStdUniformPct") / 100).alias("long_run_sd"),
    )


def series(drawn: pd.Series, sessions: pd.DataFrame, drop: float, seed: int) -> pd.DataFrame:
    """Ticks of one instrument over its sessions in order. A dropped second leaves no tick; the state goes on."""
    rng = np.random.default_rng([seed, int(drawn["instrument_id"])])
    per_second = drawn["annual_vol"] / math.sqrt(YEAR_SECONDS)
    tau = drawn["half_life"] / math.log(2)
    decay = math.exp(-1 / tau)
    shock_sd = drawn["long_run_sd"] * math.sqrt(1 - decay * decay)
    walk, before, out = 0.0, None, []
    for s in sessions.sort_values("start_ns").itertuples():
        n = (s.end_ns - s.start_ns) // NS
        if before is not None:
            gap = (s.start_ns - before.end_ns) / NS
            sd = per_second * math.sqrt(gap) if s.day == before.day else drawn["annual_vol"] / math.sqrt(YEAR_DAYS) * OVERNIGHT
            walk += rng.normal(0, sd)
        path = walk + np.cumsum(rng.normal(0, per_second, n))
        walk = float(path[-1]) if n else walk
        if drawn["is_reverter"]:
            shocks, ou, level = rng.normal(0, shock_sd, n), 0.0, np.empty(n)
            for i, e in enumerate(shocks):
                ou = ou * decay + e
                level[i] = ou
            path = path + level
        u = np.arange(n) / max(1, n)
        volume = np.maximum(1, rng.poisson(drawn["volume"] * (0.5 + 2 * (2 * u - 1) ** 2)))
        stays = rng.random(n) >= drop
        ts = s.start_ns + np.arange(n) * NS
        out.append(pd.DataFrame({"instrument_id": int(drawn["instrument_id"]), "ts_ns": ts[stays], "price": np.exp(drawn["log_start"] + path)[stays].astype(np.float32), "volume": volume[stays].astype(np.int32)}))
        before = s
    return pd.concat(out) if out else pd.DataFrame({"instrument_id": [], "ts_ns": [], "price": [], "volume": []})


def generate(spark: SparkSession, regions: DataFrame, model: dict[str, list[float]], start: str, end: str, seed: int, limit: int | None = None) -> DataFrame:
    """instrument_id, ts_ns, price, volume; the same for the same seed. limit: instruments of each region. An instrument is
    a task's group: its calendar, some hundred sessions, comes with it, its ticks are made there."""
    ids = instruments(regions)
    if limit is not None:
        first = ids.groupBy("region_id").agg(F.min("instrument_id").alias("first"))
        ids = ids.join(first, "region_id").where(F.col("instrument_id") < F.col("first") + limit).drop("first")
    rows = draw_instruments(ids, model, seed).join(calendar(regions, start, end).drop("region"), "region_id")
    drop = model["TradeSecondDropProbabilityPct"][0] / 100
    sessions = ["day", "session", "start_ns", "end_ns"]
    return rows.groupBy("instrument_id").applyInPandas(lambda rows: series(rows.iloc[0], rows[sessions], drop, seed), "instrument_id long, ts_ns long, price float, volume int")


def instants(spark: SparkSession, n: int, start_ns: int, end_ns: int, seed: int) -> DataFrame:
    """ordinal, t_ns: n uniform instants."""
    return spark.range(n).select(F.col("id").alias("ordinal"), (F.lit(start_ns) + F.floor(F.rand(seed) * (end_ns - start_ns))).cast("long").alias("t_ns"))


def positions(spark: SparkSession, n: int, sessions: DataFrame, ids: DataFrame, seed: int, in_session: float = 0.85) -> DataFrame:
    """n positions; most begin inside a session of their instrument's region, others anywhere in the calendar's span; holds
    are log-uniform from a second to five days."""
    span = sessions.agg(F.min("start_ns"), F.max("end_ns")).first()
    m = ids.count()
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    rows = spark.range(n).select(F.col("id"), F.floor(u(1) * m).cast("long").alias("instrument_id"), F.when(u(2) < 0.5, 1).otherwise(-1).alias("side"), (1 + F.floor(u(3) * 1000)).cast("long").alias("quantity"), u(4).alias("where_"), u(5).alias("pick"), u(6).alias("hold"), u(7).alias("at"))
    open_ = sessions.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("start_ns", "end_ns"))).alias("s"))
    rows = rows.join(ids.select("instrument_id", "region_id"), "instrument_id").join(open_, "region_id")
    s = F.element_at("s", (1 + F.floor(F.col("pick") * F.size("s"))).cast("int"))
    begin = F.when(F.col("where_") < in_session, s["start_ns"] + F.floor(F.col("at") * (s["end_ns"] - s["start_ns"]))).otherwise(F.lit(span[0]) + F.floor(F.col("at") * (span[1] - span[0]))).cast("long")
    hold = F.floor(F.exp(F.col("hold") * math.log(5 * 86_400)) * NS).cast("long")
    return rows.select(F.concat(F.lit("p"), "id").alias("trade_id"), "instrument_id", "side", "quantity", begin.alias("entry_ts_ns"), (begin + hold).alias("exit_ts_ns"))
