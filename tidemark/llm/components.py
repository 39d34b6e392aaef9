"""Connected components of a table of links, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links u > v. Large star: what is above u goes to the least of u's neighbourhood; small star: what is below."""
    both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    told = both.join(least, "u")
    if small:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node but roots. links: u, v, with u > v, distinct or not.

    Alternating stars, each round written to the shared folder; rounds grow with the logarithm of a component's length.
    Minima are summed map-side and only skewed joins are left to Spark to split, so a hot node does no harm."""
    links = staged(links.select("u", "v").where("u > v").distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.lit(0))).first()
    now = mark(links)
    while now[0]:
        links = staged(_star(_star(links, False), True), "links")
        before, now = now, mark(links)
        if before == now:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
