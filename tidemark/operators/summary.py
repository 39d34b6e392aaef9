"""Groups of trades by region and reverter flag: counts, daily profits and the Sharpe ratio, empty groups and days filled."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trading days of a year.
YEAR = 252.0


def grid(regions: DataFrame) -> DataFrame:
    """Every region with flag 0 and 1."""
    return regions.select("region_id", "region").withColumn("reverter_flag", F.explode(F.array(F.lit(0), F.lit(1))))


def daily_pnl(trades: DataFrame, days: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, region, reverter_flag, day, pnl of each group and day of the region with data, 0 without trades.

    trades: region_id, reverter_flag, exit_day, pnl; days: region_id, day (repeats allowed). Trades of no region drop out."""
    sums = trades.groupBy("region_id", "reverter_flag", F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("pnl"))
    cells = grid(regions).join(days.select("region_id", "day").distinct(), "region_id")
    return cells.join(sums, ["region_id", "reverter_flag", "day"], "left").select("region_id", "region", "reverter_flag", "day", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def sharpe(daily: DataFrame) -> DataFrame:
    """region_id, reverter_flag, sharpe: mean over sample deviation of daily profits, by the root of a year's days; null with
    fewer than two days or no deviation."""
    moments = daily.groupBy("region_id", "reverter_flag").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("sd"))
    return moments.select("region_id", "reverter_flag", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.try_divide("m", "sd") * F.sqrt(F.lit(YEAR))).alias("sharpe"))


def summarise(trades: DataFrame, days: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, region, reverter_flag, trade_count, total_pnl, sharpe of every region and flag."""
    sums = trades.groupBy("region_id", "reverter_flag").agg(F.count(F.lit(1)).alias("trade_count"), F.sum("pnl").alias("total_pnl"))
    ratio = sharpe(daily_pnl(trades, days, regions))
    out = grid(regions).join(sums, ["region_id", "reverter_flag"], "left").join(ratio, ["region_id", "reverter_flag"], "left")
    return out.select("region_id", "region", "reverter_flag", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.coalesce("total_pnl", F.lit(0.0)).alias("total_pnl"), "sharpe")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], cells: int = 1024) -> DataFrame:
    """One row: the values of rank ceil(p n) for each share (null if there are none), mean and max; nulls don't count.

    A sketch cuts the values into cells of about equal size, rows are counted per cell, and only the cells that hold a rank
    are looked into, by counts of their distinct values: no task sorts the whole column."""
    rows = df.select(F.col(value).alias("v")).where("v is not null")
    cuts = rows.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    edges = sorted(set(cuts))
    bounds, cell = F.lit(edges), F.lit(0)
    if edges:  # how many bounds lie below a value, by binary search
        steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
        below = lambda i: F.try_element_at(bounds, i) < F.col("v")
        cell = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when((at + s <= len(edges)) & below(at + s), s).otherwise(0))
    placed = rows.withColumn("cell", cell)
    counts = sorted((r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    wanted, before = {}, 0
    for at, n in counts:
        for name, p in shares.items():
            rank = max(1, math.ceil(p * total - 1e-9))
            if before < rank <= before + n:
                wanted[name] = (at, rank - before)
        before += n
    upto = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(F.col("cell").isin(sorted({c for c, _ in wanted.values()}))).groupBy("cell", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    picks = [F.min(F.when((F.col("cell") == wanted[n][0]) & (F.col("upto") >= wanted[n][1]), F.col("v"))) if n in wanted else F.lit(None).cast("double") for n in shares]
    found = inside.agg(*[p.alias(n) for p, n in zip(picks, shares, strict=True)])
    return found.crossJoin(df.agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value")))  # of two single rows
