"""The clustered store: versions under one folder, published by a pointer that is switched last.

store/CURRENT holds the name of a version's folder. A version has the tables ticks (clustered by instrument and time within
each UTC day), blocks, meta and, where a calendar was given, segments and regions. An ingest that fails leaves CURRENT, and
so the store that readers see, as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import DAY_NS, floor_div
from tidemark.operators import calendar as cal
from tidemark.operators.extrema import STRIDE, block_index, numbered
from tidemark.operators.rolling import not_increasing
from tidemark.sources.ticks import BadInput


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TICKS = _schema(instrument_id=T.LongType(), ts_ns=T.LongType(), price=T.FloatType(), volume=T.IntegerType(), trade_date=T.DateType())
BLOCKS = _schema(instrument_id=T.LongType(), block_no=T.LongType(), first_ts=T.LongType(), last_ts=T.LongType(), min_price=T.FloatType(), max_price=T.FloatType(), n=T.LongType())
#: Versions that a publish leaves behind the new one, for readers that have opened it.
KEPT = 1


def _fs(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _pointer(spark: SparkSession, store: str) -> str | None:
    fs, path = _fs(spark, f"{store}/CURRENT")
    return spark.read.text(f"{store}/CURRENT").first()[0] if fs.exists(path) else None


def _switch(spark: SparkSession, store: str, version: str) -> None:
    """Writes the pointer beside the old one and renames it over it, in one step of the file system."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, new = _fs(spark, f"{store}/CURRENT.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(new, jvm.Path(f"{store}/CURRENT"), how)


def ingest(raw: DataFrame, store: str, ids: DataFrame | None = None, sessions: DataFrame | None = None, stride: int = STRIDE) -> None:
    """Checks raw ticks (columns as read_raw gives them) and publishes them as a new version of the store. BadInput if a series
    isn't strictly increasing in file order. ids, sessions: instruments and calendar, for segments and regions."""
    if stride < 1:
        raise BadInput("stride must be 1 or more")
    wrong = not_increasing(raw).head()
    if wrong:
        raise BadInput(f"instrument {wrong['instrument_id']}: {wrong['ts_ns']} is not strictly increasing")
    spark, version = raw.sparkSession, f"v-{uuid.uuid4().hex}"
    at, before = f"{store}/{version}", _pointer(raw.sparkSession, store)
    dated = raw.select("instrument_id", "ts_ns", "price", "volume", F.date_from_unix_date(floor_div(F.col("ts_ns"), DAY_NS).cast("int")).alias("trade_date"))
    dated.repartitionByRange("trade_date", "instrument_id", "ts_ns").sortWithinPartitions("trade_date", "instrument_id", "ts_ns").write.partitionBy("trade_date").parquet(f"{at}/ticks")
    ticks = spark.read.schema(TICKS).parquet(f"{at}/ticks")
    block_index(ticks, stride).write.parquet(f"{at}/blocks")
    if ids is not None and sessions is not None:
        cal.segments(cal.assign_segments(ticks, ids, sessions)).write.parquet(f"{at}/segments")
        ids.join(sessions.select("region_id", "region").distinct(), "region_id", "left").select("instrument_id", "region_id", "region").write.parquet(f"{at}/regions")
    spark.range(1).select(F.lit(stride).alias("stride"), F.lit(ids is not None and sessions is not None).alias("cut")).write.parquet(f"{at}/meta")
    _switch(spark, store, version)
    fs, folder = _fs(spark, store)
    for f in fs.listStatus(folder):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() not in (version, before)[: 1 + KEPT]:
            fs.delete(f.getPath(), True)


@dataclass
class Store:
    """An opened version. segments and regions are None where the ingest had no calendar."""

    path: str
    stride: int
    ticks: DataFrame
    blocks: DataFrame
    segments: DataFrame | None
    regions: DataFrame | None

    def records(self, *ids: int) -> DataFrame:
        """Ticks of these instruments; none for unknown ones."""
        return self.ticks.where(F.col("instrument_id").isin(list(ids)))

    def between(self, instrument_id: int, begin: int, end: int) -> DataFrame:
        """Ticks of places [begin, end) of a series, with pos. The blocks tell between which times they lie, so that only
        the ticks of those are read and numbered."""
        near = self.blocks.where((F.col("instrument_id") == instrument_id) & ((F.col("block_no") + 1) * self.stride > begin) & (F.col("block_no") * self.stride < end))
        low, high, first = near.agg(F.min("first_ts"), F.max("last_ts"), F.min("block_no")).first()
        if low is None:
            return numbered(self.ticks.where(F.lit(False))).drop("block_no")
        part = numbered(self.records(instrument_id).where(F.col("ts_ns").between(low, high))).withColumn("pos", F.col("pos") + first * self.stride)
        return part.where((F.col("pos") >= begin) & (F.col("pos") < end)).drop("block_no")

    def counts(self) -> DataFrame:
        """instrument_id, n, from the blocks."""
        return self.blocks.groupBy("instrument_id").agg(F.sum("n").alias("n"))

    def look_up(self, ids: DataFrame) -> DataFrame:
        """instrument_id, n (0 for an unknown one), region_id (-1 where it has none), region of each row of ids."""
        known = ids.select("instrument_id").join(self.counts(), "instrument_id", "left")
        if self.regions is None:
            return known.select("instrument_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(-1).alias("region_id"), F.lit(None).cast("string").alias("region"))
        return known.join(self.regions, "instrument_id", "left").select("instrument_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("region_id", F.lit(-1)).alias("region_id"), "region")

    def warm(self) -> int:
        """Holds the blocks and regions in memory from here on; rows held."""
        self.blocks = self.blocks.cache()
        self.regions = self.regions.cache() if self.regions is not None else None
        return self.blocks.count() + (self.regions.count() if self.regions is not None else 0)

    def footprint(self) -> dict[str, float]:
        """Points, bytes on disk and bytes a point of this version."""
        fs, path = _fs(self.ticks.sparkSession, self.path)
        points, size = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], fs.getContentSummary(path).getLength()
        return {"points": points, "bytes": size, "bytes_per_point": size / points if points else 0.0}


def _checked(spark: SparkSession, at: str, want: T.StructType | None) -> DataFrame:
    fs, path = _fs(spark, f"{at}/_SUCCESS")
    if not fs.exists(path):
        raise BadInput(f"{at}: the table isn't there or isn't whole")
    files = [f for f in fs.listStatus(path.getParent()) if not f.getPath().getName().startswith(("_", "."))]
    if want is None or not files:
        return spark.read.schema(want).parquet(at) if want is not None else spark.read.parquet(at)
    found = spark.read.parquet(at)
    if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in want]:
        raise BadInput(f"{at}: its columns are {found.schema.simpleString()}")
    return found


def open_store(spark: SparkSession, store: str) -> Store:
    """The published version; BadInput if there is none, a table of it is missing or has other columns, or the stride is none."""
    version = _pointer(spark, store)
    if version is None:
        raise BadInput(f"{store}: not a published store")
    at = f"{store}/{version}"
    stride, cut = _checked(spark, f"{at}/meta", None).first()
    if stride < 1:
        raise BadInput(f"{store}: stride {stride}")
    more = [_checked(spark, f"{at}/{t}", None) if cut else None for t in ("segments", "regions")]
    return Store(at, stride, _checked(spark, f"{at}/ticks", TICKS), _checked(spark, f"{at}/blocks", BLOCKS), *more)


def _either(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit(names[0])).unionByName(b.exceptAll(a).withColumn("side", F.lit(names[1])))


def verify(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Ticks that only one of both has, with side raw or store; none if the store is true. Repeats count."""
    cols = ["instrument_id", "ts_ns", "price", "volume"]
    return _either(raw.select(*cols), stored.select(*cols), ("raw", "store"))


def verify_blocks(ticks: DataFrame, blocks: DataFrame, stride: int) -> DataFrame:
    """Blocks that only one of both has, made anew from ticks or stored, with side data or index; none if the index is true."""
    cols = [f.name for f in BLOCKS]
    return _either(block_index(ticks, stride).select(*cols), blocks.select(*cols), ("data", "index"))
