"""Mean reversion on rolling z-scores: one position at a time within a segment of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.rolling import FLOOR, rolling

#: Money put into a position.
STAKE = 10_000.0
TRADES = "side int, quantity long, entry_ts_ns long, exit_ts_ns long, entry_price float, exit_price float, pnl double"


def check(window: float, entry: float, exit_: float, max_hold_s: float) -> tuple[int, int]:
    """Window and hold as whole numbers; ValueError if they make no rule."""
    if int(window) < 1:
        raise ValueError("window must be 1 or more")
    if int(max_hold_s) < 0:
        raise ValueError("max-hold must be 0 or more")
    return int(window), int(max_hold_s)


def z_scores(price: np.ndarray, window: int) -> np.ndarray:
    """NaN where the window isn't full or the variance is no signal."""
    x = price - price[0] if len(price) else price
    out = np.full(len(x), np.nan)
    if len(x) < window:
        return out
    s1, s2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    mean = (s1[window:] - s1[:-window]) / window
    var = np.maximum((s2[window:] - s2[:-window]) / window - mean * mean, 0.0)
    ok = var > FLOOR * price[0] * price[0]
    out[window - 1 :][ok] = (x[window - 1 :][ok] - mean[ok]) / np.sqrt(var[ok])
    return out


def trades_of(ts: np.ndarray, price: np.ndarray, window: int, entry: float, exit_: float, max_hold_s: int) -> list[tuple[int, int, int, int]]:
    """(side, quantity, entry row, exit row) of one segment. A position closes on the first later row whose z has come back,
    that reaches the hold, or that is the last; the row that closes it opens none, nor does the last row."""
    n = len(ts)
    z = z_scores(price, window)
    with np.errstate(invalid="ignore"):
        side = np.where(z > entry, -1, np.where(z < -entry, 1, 0))
        back = {1: np.flatnonzero(z >= exit_), -1: np.flatnonzero(z <= -exit_)}
    quantity = np.floor(STAKE / np.where(price > 0, price, np.inf)).astype(np.int64)
    starts = np.flatnonzero((side != 0) & (quantity >= 1) & (np.arange(n) < n - 1))
    held = np.searchsorted(ts, ts + max_hold_s * 10**9, side="left")
    out, k = [], 0
    while k < len(starts):
        i = int(starts[k])
        d = int(side[i])
        j = np.searchsorted(back[d], i + 1)
        end = min(int(back[d][j]) if j < len(back[d]) else n - 1, max(int(held[i]), i + 1), n - 1)
        out.append((d, int(quantity[i]), i, end))
        k = int(np.searchsorted(starts, end + 1))
    return out


def strategy(ticks: DataFrame, window: float, entry: float, exit_: float, max_hold_s: float, by: tuple[str, ...] = ("instrument_id", "segment")) -> DataFrame:
    """The trades of each series and segment (columns by; by[0] names the series), in no order. Everything starts anew in
    a segment. A segment, bounded by its session, is one group of rows in one task."""
    window, hold = check(window, entry, exit_, max_hold_s)
    keys = ticks.select(*by).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", " + TRADES

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts_ns")
        ts, single = rows["ts_ns"].to_numpy(np.int64), rows["price"].to_numpy()
        price = single.astype(np.float64)
        got = trades_of(ts, price, window, entry, exit_, hold)
        d, q, i, j = (np.array([g[c] for g in got], np.int64) for c in range(4))
        out = pd.DataFrame({"side": d.astype(np.int32), "quantity": q, "entry_ts_ns": ts[i], "exit_ts_ns": ts[j], "entry_price": single[i].astype(np.float32), "exit_price": single[j].astype(np.float32), "pnl": d * q * (price[j] - price[i])})
        for name, value in reversed(list(zip(by, key, strict=True))):
            out.insert(0, name, value)
        return out

    return ticks.select(*by, "ts_ns", "price").groupBy(*by).applyInPandas(run, schema)


def strategy_by_windows(ticks: DataFrame, window: float, entry: float, exit_: float, max_hold_s: float, by: tuple[str, ...] = ("instrument_id", "segment")) -> DataFrame:
    """The same trades from windows and one fold over candidates, without Python: a cross-check of the grouped form."""
    window, hold = check(window, entry, exit_, max_hold_s)
    rows = rolling(ticks.select(*by, "ts_ns", "price"), window, by)
    all_ = Window.partitionBy(*by)
    later = all_.orderBy(F.desc("ts_ns")).rowsBetween(Window.unboundedPreceding, -1)
    held = all_.orderBy(F.desc("ts_ns")).rangeBetween(Window.unboundedPreceding, -hold * 10**9)
    n = F.count(F.lit(1)).over(all_)
    price = F.col("price").cast("double")
    rows = rows.select(*by, "ts_ns", "price", "pos", "z", n.alias("n"),
        F.min(F.when(F.col("z") >= exit_, F.col("pos"))).over(later).alias("up"), F.min(F.when(F.col("z") <= -exit_, F.col("pos"))).over(later).alias("down"), F.min("pos").over(held).alias("late"),
        F.when(price > 0, F.floor(F.lit(STAKE) / price)).otherwise(F.lit(0)).alias("quantity"),
        F.when(F.col("z") > entry, -1).when(F.col("z") < -entry, 1).alias("side"))
    late = F.when(F.col("late").isNotNull(), F.greatest(F.col("late"), F.col("pos") + 1))
    rows = rows.withColumn("end", F.least(F.when(F.col("side") == 1, F.col("up")).otherwise(F.col("down")), late, F.col("n")).cast("int"))
    cand = rows.where(F.col("side").isNotNull() & (F.col("quantity") >= 1) & (F.col("pos") < F.col("n")))
    packed = cand.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "end", "side", "quantity", "ts_ns", "price"))).alias("c"))
    none = F.struct(F.lit(0).alias("last"), F.expr("cast(array() as array<int>)").alias("kept"))
    fold = F.aggregate("c", none, lambda a, x: F.when(x["pos"] > a["last"], F.struct(x["end"].alias("last"), F.concat(a["kept"], F.array(x["pos"])).alias("kept"))).otherwise(a))
    kept = packed.select(*by, F.explode(F.filter("c", lambda x: F.lit(True))).alias("x"), fold["kept"].alias("kept")).where(F.array_contains("kept", F.col("x.pos")))
    ends = rows.select(*by, F.col("pos").alias("end"), F.col("ts_ns").alias("exit_ts_ns"), F.col("price").alias("exit_price"))
    out = kept.select(*by, "x.*").withColumnsRenamed({"ts_ns": "entry_ts_ns", "price": "entry_price"}).join(ends, [*by, "end"])
    pnl = F.col("side") * F.col("quantity") * (F.col("exit_price").cast("double") - F.col("entry_price").cast("double"))
    return out.select(*by, F.col("side").cast("int").alias("side"), F.col("quantity").cast("long").alias("quantity"), "entry_ts_ns", "exit_ts_ns", "entry_price", "exit_price", pnl.alias("pnl"))
