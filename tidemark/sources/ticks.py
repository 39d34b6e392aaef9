"""Raw day files of 16-byte tick records."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import DAY_NS, floor_div

#: Fixed values of the raw format: little-endian record, file names.
RECORD = np.dtype([("ts_ns", "<i8"), ("price", "<f4"), ("volume", "<i4")])
NAME = r"/(\d{8})/(\d{4})\.bin$"


class BadInput(ValueError):
    """Raw files that break the format."""


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """instrument_id, ts_ns, price, volume, seq (file order) of folder/YYYYMMDD/NNNN.bin; other files are skipped. BadInput
    if a file isn't whole records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(folder).where(F.col("path").rlike(NAME))
    torn = files.where(F.col("length") % RECORD.itemsize != 0).select("path").head()
    if torn:
        raise BadInput(f"{torn[0]}: not a multiple of {RECORD.itemsize} bytes")
    named = files.select(F.regexp_extract("path", NAME, 1).cast("long").alias("day"), F.regexp_extract("path", NAME, 2).cast("long").alias("instrument_id"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for day, i, content in zip(*(b.column(c) for c in ("day", "instrument_id", "content")), strict=True):
                v = np.frombuffer(content.as_buffer(), RECORD)
                seq = day.as_py() * 10_000_000 + np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i.as_py())), pa.array(v["ts_ns"].copy()), pa.array(v["price"].copy()), pa.array(v["volume"].copy()), pa.array(seq)], names=["instrument_id", "ts_ns", "price", "volume", "seq"])

    return named.mapInArrow(decode, "instrument_id long, ts_ns long, price float, volume int, seq long")


def write_raw(ticks: DataFrame, folder: str, ids: DataFrame | None = None, days: DataFrame | None = None) -> int:
    """folder/YYYYMMDD/NNNN.bin by UTC day; how many files. folder: any store that all executors reach, as a URI or path.
    With ids (instrument_id) and days (trade_date) each of them gets a file on each day, an empty one where it has no ticks.

    A file is written under a name of its own and then renamed, so a task that is run again leaves one whole file."""
    dated = ticks.select("instrument_id", F.date_from_unix_date(floor_div(F.col("ts_ns"), DAY_NS).cast("int")).alias("trade_date"), "ts_ns", "price", "volume")
    if ids is not None and days is not None:
        grid = ids.select("instrument_id").distinct().crossJoin(days.select("trade_date").distinct())  # the files asked for
        dated = dated.unionByName(grid, allowMissingColumns=True)
    dated = dated.select("instrument_id", "trade_date", F.col("ts_ns").isNotNull().alias("real"), *[F.coalesce(c, F.lit(0).cast(k)).alias(c) for c, k in (("ts_ns", "long"), ("price", "float"), ("volume", "int"))])

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, day = key
        store, root = pafs.FileSystem.from_uri(folder)
        rows = rows[rows["real"]].sort_values("ts_ns")
        v = np.empty(len(rows), RECORD)
        for c in RECORD.names:
            v[c] = rows[c].to_numpy(RECORD[c])
        at = f"{root}/{day:%Y%m%d}/{i:04d}.bin"
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(new := f"{at}.{uuid.uuid4().hex}") as f:
            f.write(v.tobytes())
        store.move(new, at)
        return pd.DataFrame({"n": [len(v)]})

    return dated.groupBy("instrument_id", "trade_date").applyInPandas(encode, "n long").count()
