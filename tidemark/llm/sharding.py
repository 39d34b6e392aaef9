"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A directory with a few cells for each shard that the mean needs is summed once from the rows. From its cells the levels
above are climbed one at a time, each half as large as the one below: a bucket is a shard if it fits and the bucket that it
was split from doesn't. Cells that don't fit themselves split on: only their rows are summed again, over more bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import row_name, staged

#: Bytes of text that a shard holds at most, and the bits of the hash that a directory can use.
LIMIT, BITS = 8 << 20, 40
#: Bits more than the mean needs that a first directory has, and bits that a later one adds.
SLACK, MORE = 2, 6
#: Rows of a bucket of repeated rows that are numbered in one task, about, if all rows are such.
CROWD_ROWS = 100_000


def _directory(cells: DataFrame, top: int, above: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """From cells (cell of top bits, b bytes) whose buckets of `above` bits are known not to fit (-1: not known of any):
    a row per cell that lies in a bucket that fits (cell, depth, bucket, shard_bytes), and the cells that don't fit."""
    last = top == BITS
    over = F.lit(False) if last else F.col("b") > limit  # beyond the last bit nothing splits
    level = cells.select(F.col("cell").alias("bucket"), "b", over.alias("over"))
    found = []
    for depth in range(top, above, -1):
        if depth == above + 1:
            level = level.withColumn("split", F.lit(True))
        else:
            pair = Window.partitionBy(F.shiftright("bucket", 1))
            level = level.select("*", F.sum("b").over(pair).alias("up"), F.max("over").over(pair).alias("low")).withColumn("split", F.col("low") | (F.col("up") > limit))
        level = staged(level, "shard-level")
        found.append(level.where("split and not over").select(F.lit(depth).alias("depth"), "bucket", F.col("b").alias("shard_bytes")))
        if level.where("not split").isEmpty():
            break
        level = level.groupBy(F.shiftright("bucket", 1).alias("bucket")).agg(F.sum("b").alias("b"), F.max("split").alias("over"))
    fit = found[0]
    for part in found[1:]:
        fit = fit.unionByName(part)
    spread = fit.withColumn("cell", F.explode(F.sequence(F.expr(f"shiftleft(bucket, {top} - depth)"), F.expr(f"shiftleft(bucket + 1, {top} - depth) - 1"))))
    spread = spread.join(cells.select("cell"), "cell", "left_semi")
    return staged(spread.select("cell", "depth", "bucket", "shard_bytes"), "shard-directory"), staged(cells.where(~F.lit(last) & (F.col("b") > limit)).select("cell"), "shard-over")


def assigned(docs: DataFrame, *more, limit: int = LIMIT) -> DataFrame:
    """From docs: doc_id, n_bytes, depth, bucket (the prefix of depth bits), chunk, shard_bytes and the columns in more.

    The hash is of id and text, so neither a hot id nor a hot text fills one bucket unless both repeat. A bucket stays at
    the smallest depth at which it fits. Rows that agree in all BITS bits (repeated rows) can't be told apart by the hash:
    their bucket is cut into chunks of as many rows as surely fit; a single row over the limit is a chunk alone. Null
    text: 0 bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = row_name(F.col("doc_id").cast("long"), text)
    hashed = F.shiftright(F.conv(F.substring(name, 1, 15), 16, 10).cast("long"), 60 - BITS)
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), hashed.alias("h"), F.monotonically_increasing_id().alias("uid"), *more), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    done, left, above, top = None, rows, -1, min(BITS, (total // limit).bit_length() + SLACK)
    while True:
        at = F.shiftright("h", BITS - top)
        cells = staged(left.groupBy(at.alias("cell")).agg(F.sum("n_bytes").alias("b")), "shard-cells")
        directory, over = _directory(cells, top, above, limit)
        part = left.withColumn("cell", at).join(directory, "cell").drop("cell")
        done = part if done is None else done.unionByName(part)
        if over.isEmpty():
            break
        left = staged(left.withColumn("cell", at).join(over, "cell", "left_semi").drop("cell"), "shard-left")
        above, top = top, min(BITS, top + MORE)
    full = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    fits = done.where(~full).withColumn("chunk", F.lit(0).cast("long"))
    if top < BITS:
        return fits.drop("h", "uid")
    # rows are numbered by salt, from sums per salt, so that no task sees a whole bucket
    crowd = staged(done.where(full).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(count // CROWD_ROWS + 1))), "shard-crowd")
    whole = Window.partitionBy("bucket")
    earlier = whole.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = crowd.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most"))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("most").over(whole), F.lit(1))))
    parts = parts.select("bucket", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), per.alias("per"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("uid")) - 1
    cut = crowd.join(parts, ["bucket", "salt"]).withColumn("chunk", F.floor(number / F.col("per"))).drop("salt", "base", "per")
    cut = cut.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("bucket", "chunk")))
    return fits.unionByName(cut).drop("h", "uid")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (bits of its prefix, * for none, and a chunk number where a bucket is cut), depth,
    shard_bytes, for every row of docs. An empty table gives no rows."""
    return _named(assigned(docs, limit=limit)).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of docs with all columns, their shard and its bytes as columns shard_id and shard_bytes after them (columns
    of these names in docs are replaced)."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    told = _named(assigned(docs, row, limit=limit))
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("shard_id", "shard_bytes")]
    return told.select(*kept, F.col("shard").alias("shard_id"), "shard_bytes")


def _named(told: DataFrame) -> DataFrame:
    bits = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return told.withColumn("shard", F.when(F.col("chunk") > 0, F.concat(bits, F.lit("."), F.col("chunk").cast("string"))).otherwise(bits))


def oracle(limit: int = LIMIT, deepest: int = 24) -> str:
    """The same for DuckDB, from documents, for tables in which no bucket needs more than deepest bits."""
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) >> {60 - BITS} AS h
  FROM documents
), f AS (
  SELECT d.*, depth, h >> ({BITS} - depth) AS bucket FROM d, (SELECT unnest(range(0, {deepest + 1})) AS depth) AS l
), b AS (
  SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM f GROUP BY ALL HAVING sum(n_bytes) <= {limit}
), s AS (
  SELECT f.*, shard_bytes, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM f JOIN b USING (depth, bucket)
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(bucket), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, shard_bytes
FROM s WHERE k = 1
"""
