"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts.

DataFrame functions only. Each row gets a random-looking number from its id and text; a source's rows, sorted by it, are
cut into ranges of that number. Sums per range, prefix sums over ranges and running sums inside a range give every row its
start in its source without any task seeing a whole source. Rows that agree in id and text have one number, however many
they are: a crowd of them stands in its range as one row of their summed size, and is numbered apart, by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, row_name, staged

#: Weights of the sources in order, repeating; share of all sizes that the mix takes; times that a source may repeat.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Bits of the random number; a range of it holds about so many rows of the table, or half; bits of a range at most.
BITS, RANGE_ROWS, RANGE_BITS = 60, 1024, 36
#: Rows of a range beyond which repeated rows in it are told apart by salt; rows of a salt, about.
CROWD_ROWS = 8 * RANGE_ROWS


def random_key(name: Column, seed: str) -> Column:
    """60 bits of md5 of the seed and a name; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """From (source, source_size), a row per source: adds target. Sources by code point, null last, weigh weights[i mod n].

    Targets are min(repeats * size, level * weight) with the level at which they add up to share of all sizes: by
    size over weight, a source is at its limit if giving all before it their limits leaves it more than that."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))).withColumn("most", F.col("source_size") * float(repeats))
    by = every.orderBy((F.col("most") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    told = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("given"),
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    ).withColumn("level", F.greatest((F.col("total") * share - F.col("given")) / F.col("left"), F.lit(0.0)))
    full = F.col("level") * F.col("weight") >= F.col("most")
    level = F.min(F.when(~full, F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(every)["level"]
    return told.select("source", "source_size", F.when(full | level.isNull(), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def source_key(source: Column) -> Column:
    """Joins as it sorts, null last and apart from the empty name."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _bases(cells: DataFrame, bits: int) -> DataFrame:
    """s, range, base: what lies before a range in its source. Prefix sums at two levels, so that no task sees all ranges."""
    low = bits // 2
    coarse = cells.withColumn("coarse", F.shiftright("range", low))
    sums = coarse.groupBy("s", "coarse").agg(F.sum("cell").alias("sum"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("s", "coarse", (F.sum("sum").over(upto("s", "coarse")) - F.col("sum")).alias("before"))
    inner = coarse.select("s", "coarse", "range", (F.sum("cell").over(upto("s", "coarse", "range")) - F.col("cell")).alias("inner"))
    return inner.join(sums, ["s", "coarse"]).select("s", "range", (F.col("before") + F.col("inner")).alias("base"))


def _started(rows: DataFrame, cells: DataFrame, base: DataFrame) -> DataFrame:
    """rows with start, the sizes that stand before each in its source."""
    inside = Window.partitionBy("s", "range").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum("mass").over(inside) - F.col("mass")
    crowded = cells.where(F.col("n") > CROWD_ROWS).select("s", "range")
    if crowded.isEmpty():
        return rows.withColumn("mass", F.col("size")).join(base, ["s", "range"]).withColumn("start", start).drop("mass", "base")
    same = ["s", "range", "at", "tie", "size"]
    crowds = staged(rows.join(crowded, ["s", "range"], "left_semi").groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANGE_ROWS), "mix-crowds")
    alone = rows.join(crowds, same, "left_anti").withColumn("mass", F.col("size"))
    stands = crowds.withColumn("mass", F.col("size") * F.col("n")).withColumn("crowd", F.col("n"))
    laid = alone.withColumn("crowd", F.lit(None).cast("long")).unionByName(stands.drop("n"), allowMissingColumns=True).join(base, ["s", "range"]).withColumn("start", start)
    firsts = staged(laid.where("crowd is not null").select(*same, "crowd", F.col("start").alias("first"), "source_size", "target"), "mix-crowd-starts")
    salt = F.pmod(F.xxhash64("uid"), F.floor(F.col("crowd") / CROWD_ROWS) + 1)
    copies = rows.join(firsts, same).withColumn("salt", salt)
    parts = staged(copies.groupBy(*same, "salt").agg(F.count(F.lit(1)).alias("n")), "mix-salts")
    before = Window.partitionBy(*same).orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy(*same, "salt").orderBy("uid")) - 1
    numbered = copies.join(parts, [*same, "salt"]).withColumn("start", F.col("first") + (F.col("before") + number) * F.col("size"))
    return laid.where("crowd is null").drop("mass", "base", "crowd").unionByName(numbered.drop("salt", "before", "first", "crowd"))


def plan(rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """From (doc_id, source, size, name, tie, ...): adds source_size, target and taken, the words that the mix takes of the
    row, repeats counted: whole epochs of the source, then rows in random order up to the exact budget; the row in which
    it ends is taken in part. Equal random numbers go by id and tie; sizes of 0 take 0."""
    rows = rows.withColumn("at", random_key(F.col("name"), seed)).withColumn("s", source_key(F.col("source"))).drop("name")
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    bits = min(RANGE_BITS, max(4, (rows.count() // RANGE_ROWS).bit_length()))
    ranged = rows.withColumn("range", F.shiftright("at", BITS - bits))
    cells = staged(ranged.groupBy("s", "range").agg(F.sum("size").alias("cell"), F.count(F.lit(1)).alias("n")), "mix-cells")
    sizes = cells.groupBy("s").agg(F.sum("cell").alias("source_size")).select(F.when(~F.col("s.none"), F.col("s.name")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, repeats).select(source_key(F.col("source")).alias("s"), "source_size", "target")
    base = _bases(cells, bits).join(targets, "s")
    told = _started(ranged, cells, base)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return told.withColumn("taken", taken.cast("long")).drop("s", "at", "range", "start", "uid")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        row_name(F.col("doc_id").cast("long"), text).alias("name"),
        F.xxhash64(text).alias("tie"),
        *more,
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row. Null text: size 0; null source: a source of its own, last.
    Repeated rows are rows of their own and may take different amounts. An empty table gives no rows."""
    return plan(sized(docs), seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, all columns, each as often as it is taken whole; the row in which a source's budget
    ends is cut after the words still taken, and its n_chars, if there, follows. Whole rows go through the plan, so a
    text is written and dealt once and no join brings it back."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    told = plan(sized(docs, row), seed).where("taken > 0")
    whole, part = F.expr("taken div size"), F.expr("taken % size")
    told = told.withColumn("part", part).withColumn("copy", F.explode(F.sequence(F.lit(1), (whole + F.when(part > 0, 1).otherwise(0)).cast("int"))))
    cut = (F.col("part") > 0) & (F.col("copy") > whole)
    at = f"row.c{docs.columns.index('text')}"
    pieces = F.regexp_extract_all(F.col(at), F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    told = told.withColumn("shown", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col(at)))
    out = []
    for i, (c, kind) in enumerate(docs.dtypes):
        value = F.col(f"row.c{i}")
        if c == "text":
            value = F.col("shown")
        elif c == "n_chars":
            value = F.when(cut, F.length("shown")).otherwise(value).cast(kind)
        out.append(value.alias(c))
    return told.select(*out)


#: The same for DuckDB, from documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, ''))), 1, 15) AS BIGINT) AS at, coalesce(text, '') AS tie
  FROM documents
), z AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM z
), v AS (
  SELECT *, greatest((sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM k
), w AS (
  SELECT *, (SELECT arg_min(level, most / weight) FROM v WHERE level * weight < most) AS common FROM v
), t AS (
  SELECT source, source_size, CASE WHEN level * weight >= most OR common IS NULL THEN most ELSE common * weight END AS target FROM w
), s AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(greatest(floor(target) - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM s
"""
