"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For a term k of weight w and sample s: r, c ~ Gamma(2, 1) and b ~ U(0, 1) are fixed by (k, s);
t = floor(ln w / r + b), a = c exp(-r (t - b + 1)), and the sample is the (k, t) of least a over all terms. As a is a
function of (k, t, s) alone, equal least values stand for equal samples, so a minimum of doubles keeps the whole sample;
the share of equal samples of two texts has the generalised Jaccard similarity of their term weights as its mean.

r is drawn as -ln(u v) of two uniforms, and b as ln v / ln(u v), which is uniform and independent of r. Then r b = -ln v and
a = c u exp(-r t) with t = floor((ln w - ln v) / r); a term of weight 1, as most are, has t = 0 and a = c u.
Terms are lower-cased words, weights their counts. Each sample is drawn over all terms of a text. A term is repeated for
each of GROUPS groups of LANES samples, so that the code of an aggregate stays small enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import input_columns, staged

#: A text has GROUPS * LANES samples; each shows as 8 hex digits.
GROUPS, LANES = 8, 8
#: Bytes of text in a block of neighbours, about; blocks at most, and rows that are looked at to cut them, about.
BLOCK_BYTES, MOST_BLOCKS, LOOKED_AT = 2 << 20, 100_000, 250_000
#: Rows that agree in id and text beyond which they are one row until the end.
CROWD_ROWS = 1000


def _uniform(h: Column, shift: int) -> Column:
    """In (0, 1), from 32 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * 2.0**-32


def draw(term: Column, lane: Column) -> Column:
    """a of a term of weight 1: c u. term: a 64-bit hash."""
    g = F.xxhash64(term, lane)
    h = F.xxhash64(g)
    return -F.log(_uniform(h, 0) * _uniform(h, 32)) * _uniform(g, 0)


def sample(drawn: Column, term: Column, log_weight: Column, lane: Column) -> Column:
    """a of a term of any weight; null for a null one. drawn: its draw, a column that both weights of a term share."""
    g = F.xxhash64(term, lane)
    rb = -F.log(_uniform(g, 32))
    r = rb - F.log(_uniform(g, 0))
    return drawn * F.when(log_weight == 0.0, 1.0).when(log_weight > 0.0, F.exp(-r * F.floor((log_weight + rb) / r).cast("double")))


def _ends(rows: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Keys (k, th) that end blocks of neighbours, ascending; the last is the greatest. Every so many of the keys with the
    least hashes, of which a bounded number is looked at."""
    mass, count, last = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.max(F.struct("k", "th"))).first()
    if last is None:
        return []
    n = int(min(MOST_BLOCKS, max(1, (mass or 0) // block_bytes)))
    if n == 1:
        return [tuple(last)]
    every = max(1, min(16, LOOKED_AT // n))
    seen = rows.where(F.pmod(F.xxhash64("k", "th", F.lit(7)), F.lit(max(1, count // (every * n)))) == 0).select("k", "th").distinct()
    return sorted({*[tuple(r) for r in seen.orderBy("k", "th").collect()][every - 1 :: every], tuple(last)})


def _longs(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _block_of(k: Column, th: Column, ends: list[tuple[int, int]]) -> Column:
    """How many ends lie below (k, th): a binary search, so the number of blocks may be large."""
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    ks, ths = _longs([e[0] for e in ends]), _longs([e[1] for e in ends])
    key = lambda i: F.try_element_at(ks, i)
    below = lambda i: (key(i) < k) | ((key(i) == k) & (F.try_element_at(ths, i) < th))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when((at + s <= len(ends)) & below(at + s), s).otherwise(0))


def _crowds_once(rows: DataFrame) -> DataFrame:
    """rows with times, the rows that each stands for. Of more than CROWD_ROWS rows that agree in id and text two are left,
    the first for all but one: each of those has another as its next. What repeats is counted map-side, by hash."""
    crowds = staged(rows.groupBy("k", "th").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD_ROWS), "text-crowds")
    if crowds.isEmpty():
        return rows.withColumn("times", F.lit(1).cast("long"))
    alone = rows.join(crowds, ["k", "th"], "left_anti").withColumn("times", F.lit(1).cast("long"))
    first = rows.join(crowds, ["k", "th"]).groupBy("k", "th").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("n").alias("n"))
    return alone.unionByName(first.withColumn("times", F.explode(F.array(F.col("n") - 1, F.lit(1).cast("long")))).drop("n"))


def neighbours(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, rn, own, k, doc_id, text, times, next: every row with the text of the next by descending id (equal ids by a
    hash of the text; null ids last; after the last the first). Rows of own = false are copies of the next block's first,
    for lead(). A row stands for `times` rows.

    A text is dealt once, by block. Blocks are ranges of (id, hash of the text), so neither a hot id nor a hot text is one
    block; each also gets the rows that end the block below."""
    rows = input_columns(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    ends = _ends(rows, block_bytes) or [(0, 0)]
    rows = _crowds_once(rows)
    at = _block_of(F.col("k"), F.col("th"), ends)
    ks, ths = (_longs([e[i] for e in ends]) for i in (0, 1))
    end = F.try_element_at(ks, F.col("at") + 1) == F.col("k")
    final = F.coalesce(end & (F.try_element_at(ths, F.col("at") + 1) == F.col("th")), F.lit(False))
    place = lambda block, guest: F.struct(block.cast("int").alias("block"), F.lit(guest).alias("guest"))
    to = F.when(final & (F.col("at") == len(ends) - 1), F.array(place(F.col("at"), 0), place(F.lit(0), 2)))
    to = to.when(final, F.array(place(F.col("at"), 0), place(F.col("at") + 1, 1))).otherwise(F.array(place(F.col("at"), 0)))
    placed = rows.withColumn("at", at).withColumn("to", F.explode(to)).select("to.*", "k", "th", "doc_id", "text", "times")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ends) // 3)
    order = Window.partitionBy("block").orderBy("guest", F.desc("k"), F.desc("th"), F.desc("times"))
    return placed.repartition(tasks, "block").select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next")).withColumn("own", F.col("guest") == 0)


EMPTY = 0


def _codes(names: list[str]) -> Column:
    """32 bits of each sample, above 0; EMPTY in a text without terms."""
    code = lambda n: F.xxhash64(n).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    return F.array(*[F.when(F.col(n).isNull(), F.lit(EMPTY)).otherwise(code(n)).cast("long") for n in names])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without terms."""
    count = lambda hit: F.aggregate(F.zip_with(a, b, lambda x, y: hit(x, y).cast("int")), F.lit(0), lambda n, x: n + x)
    seen = count(lambda x, y: (x != EMPTY) | (y != EMPTY))
    return F.when(seen == 0, F.lit(1.0)).otherwise(count(lambda x, y: (x == y) & (x != EMPTY)) / seen)


def _shown(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))), "")


def _words(c: Column) -> Column:
    return F.split(F.lower(c), "[\\x20\\x09-\\x0D]+")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next row's.
    A null text is empty; texts without words have equal fingerprints; repeated rows give a row each, of a crowd of them one is
    sampled; a table of one
    row has itself as next. After the texts are dealt by block, words, counts and samples stay in their tasks."""
    rows = neighbours(docs)
    half = F.expr("cast(floor(length(text) / 2) as int)")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.when(F.col("own"), F.concat(F.expr(f"substring(text, 1, length(text) - {'cast(floor(length(text) / 2) as int)'})"), F.substring("next", F.lit(1), half))).otherwise(F.lit(""))
    )
    rows = rows.withColumn("first", _words(F.col("text")))
    told = rows.where("own").select("block", "rn", "doc_id", "n_chars", "times", F.sha2("edited", 256).alias("edited_sha256"))
    words = rows.select("block", "rn", "doc_id", F.size("first").alias("n_first"), F.posexplode(F.concat("first", _words(F.col("edited")))).alias("pos", "word"))
    mine = (F.col("pos") < F.col("n_first")).cast("int")
    counted = words.select("block", "rn", "doc_id", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), mine.alias("a"), (1 - mine).alias("b"))
    # doc_id is a key here so that both branches read the same exchange of texts
    counted = counted.groupBy("block", "rn", "doc_id", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    log = lambda c: F.when((F.col(c) > 0) & F.col("term").isNotNull(), F.log(F.col(c).cast("double")))
    weighed = counted.select("block", "rn", "term", log("a").alias("wa"), log("b").alias("wb"), F.explode(F.array(*[F.lit(g) for g in range(GROUPS)])).alias("group"))
    lane = lambda i: F.col("group") * LANES + i
    drawn = weighed.select("*", *[draw(F.col("term"), lane(i)).alias(f"a{i}") for i in range(LANES)])
    mins = [F.min(sample(F.col(f"a{i}"), F.col("term"), F.col(w), lane(i))).alias(f"{w}{i}") for i in range(LANES) for w in ("wa", "wb")]
    groups = drawn.groupBy("block", "rn", "group").agg(*mins)
    groups = groups.select("block", "rn", F.struct("group", F.struct(_codes([f"wa{i}" for i in range(LANES)]).alias("x"), _codes([f"wb{i}" for i in range(LANES)]).alias("y"))).alias("v"))
    found = groups.groupBy("block", "rn").agg(F.map_from_entries(F.collect_list("v")).alias("v"))
    none = F.array(*[F.lit(EMPTY).cast("long")] * LANES)
    lanes = lambda c: F.flatten(F.array(*[F.coalesce(F.try_element_at("v", F.lit(g))[c], none) for g in range(GROUPS)]))
    found = found.select("block", "rn", lanes("x").alias("x"), lanes("y").alias("y")).withColumn("z", F.lead("x").over(Window.partitionBy("block").orderBy("rn")))
    told = told.join(found, ["block", "rn"])
    digests = ["doc_id", "n_chars", "edited_sha256", _shown(F.col("x")).alias("fingerprint"), _shown(F.col("y")).alias("edited_fingerprint"), likeness(F.col("x"), F.col("y")).alias("near_edited"), likeness(F.col("x"), F.col("z")).alias("near_next")]
    return told.select(*digests, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")
