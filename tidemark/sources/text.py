"""Text inputs and outputs: positions, instants, reverters, priced positions, snapshots, summaries and the run log."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import resource
import time
import uuid
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import number_text
from tidemark.sources.ticks import BadInput

#: The columns of the text formats, in order.
POSITION = ("trade_id", "instrument_id", "side", "quantity", "entry_ts_ns", "exit_ts_ns")
PRICED = ("trade_id", "status", "entry_ts_ns", "exit_ts_ns", "entry_price", "exit_price", "pnl", "max_adverse_excursion")
TRADE = ("instrument_id", "side", "quantity", "entry_ts_ns", "exit_ts_ns", "entry_price", "exit_price", "pnl")
SUMMARY = ("region", "reverter_flag", "trade_count", "total_pnl", "sharpe")
#: Width of an exported snapshot matrix.
MATRIX = 2000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without carriage returns and outer blanks, numbered from 1 in file order (one file). A line's number is its
    place in its part of the file and the counts of the parts before, so no task reads more than its part."""
    at = F.monotonically_increasing_id()
    raw = spark.read.text(path).select(F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    parts = raw.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each part of the file
    parts = parts.select("part", (F.sum("n").over(upto) - F.col("n")).alias("base"))
    return raw.join(parts, "part").select("line", (F.col("base") + F.col("place") + 1).alias("number"))


def _whole(lines: DataFrame, bad: Column) -> None:
    wrong = lines.where(bad).agg(F.min(F.struct("number", "line"))).first()[0]
    if wrong:
        raise BadInput(f"line {wrong['number']}: {wrong['line']!r}")


def _not(kind: str, text: Column) -> Column:
    """Whether text isn't a plain whole number of the kind."""
    return ~text.rlike(r"^-?\d+$") | text.try_cast(kind).isNull()


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """ordinal and the six columns of POSITION; no quoting; blank lines are skipped, and the first line if it begins with a
    letter. BadInput names the first bad line, numbers out of range among them."""
    lines = _lines(spark, path).where("line <> ''").where(~((F.col("number") == 1) & F.col("line").rlike("^[A-Za-z]")))
    part = F.split("line", ",", -1)
    kinds = ("string", "long", "int", "long", "long", "long")
    at = lambda i: F.try_element_at(part, F.lit(i + 1))
    bad = F.size(part) != len(POSITION)
    for i, k in enumerate(kinds[1:], 1):
        bad = bad | _not(k, at(i))
    _whole(lines, bad)
    return lines.select((F.col("number") - 1).alias("ordinal"), *[at(i).cast(k).alias(c) for i, (c, k) in enumerate(zip(POSITION, kinds, strict=True))])


def read_instants(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, t_ns: one integer a line, repeats and order kept."""
    lines = _lines(spark, path).where("line <> ''")
    _whole(lines, _not("long", F.col("line")))
    return lines.select((F.col("number") - 1).alias("ordinal"), F.col("line").cast("long").alias("t_ns"))


def read_reverters(spark: SparkSession, path: str, n: int) -> DataFrame:
    """instrument_id of each line below n."""
    lines = _lines(spark, path).where("line <> ''")
    _whole(lines, _not("long", F.col("line")) | F.col("line").startswith("-"))
    return lines.select(F.col("line").cast("long").alias("instrument_id")).where(F.col("instrument_id") < n)


@contextlib.contextmanager
def _out(path: str) -> Iterator[IO[bytes]]:
    """A file on any store, under another name until it is whole."""
    store, at = pafs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(new := f"{at}.{uuid.uuid4().hex}") as f:
        yield f
    store.move(new, at)


def write_lines(rows: DataFrame, column: str, order: list[str], path: str) -> None:
    """One text file of a column's values in the given order: positions, instants and reverters as they are read."""
    with _out(path) as f:
        for (line,) in rows.orderBy(*order).select(F.col(column).cast("string")).toLocalIterator():
            f.write(f"{line}\n".encode())


def write_reverters(ids: DataFrame, path: str) -> None:
    """instrument_id of those with is_reverter, ascending, one a line."""
    write_lines(ids.where(F.col("is_reverter").cast("int") == 1), "instrument_id", ["instrument_id"], path)


def _csv(rows: DataFrame, columns: tuple[str, ...], order: list[str], path: str, header: bool = True) -> None:
    """One file in the given order: a range sort, then one writer, as readers of the format want it."""
    told = []
    for c in columns:
        kind = rows.schema[c].dataType.simpleString()
        text = number_text(F.col(c), kind == "float") if kind in ("float", "double") else F.col(c).cast("string")
        told.append(F.coalesce(text, F.lit("")).alias(c))
    lines = rows.orderBy(*order).select(F.concat_ws(",", *told).alias("value"))
    with _out(path) as f:
        if header:
            f.write((",".join(columns) + "\n").encode())
        for (line,) in lines.toLocalIterator():
            f.write(f"{line}\n".encode())


def write_priced(rows: DataFrame, path: str) -> None:
    """Priced positions in input order (column ordinal); unresolved ones have empty fields."""
    _csv(rows, PRICED, ["ordinal"], path)


def write_trades(rows: DataFrame, path: str) -> None:
    _csv(rows, TRADE, ["instrument_id", "entry_ts_ns"], path)


def write_summary(rows: DataFrame, path: str, json_path: str | None = None) -> None:
    """Regions in list order, flags 0 and 1; a ratio that doesn't exist is nan, and null in the JSON array."""
    out = rows.withColumn("sharpe", F.coalesce("sharpe", F.lit(float("nan"))))
    _csv(out, SUMMARY, ["region_id", "reverter_flag"], path)
    if json_path:
        told = [r.asDict() for r in rows.orderBy("region_id", "reverter_flag").select(*SUMMARY).collect()]  # two rows a region
        with _out(json_path) as f:
            f.write(json.dumps(told).encode())


def write_matrix(rows: DataFrame, path: str, width: int = MATRIX) -> None:
    """float32[instants][width], row-major, NaN where no price is known; ids of width or more are left out."""
    packed = rows.where(F.col("instrument_id").between(0, width - 1)).groupBy("ordinal").agg(F.collect_list(F.struct("instrument_id", "price")).alias("v"))
    with _out(path) as f:
        for r in packed.orderBy("ordinal").toLocalIterator():
            line = np.full(width, np.nan, "<f4")
            for i, p in r["v"]:
                line[i] = np.nan if p is None else p
            f.write(line.tobytes())


def read_matrix(spark: SparkSession, path: str, width: int = MATRIX) -> DataFrame:
    """row (from 0), instrument_id, price of each value of a matrix that is one; read in pieces of whole rows."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            store, at = pafs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                for k in b.column("id").to_pylist():
                    v = np.frombuffer(f.read_at(4 * width, 4 * width * k), "<f4")
                    i = np.flatnonzero(~np.isnan(v))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(v[i])], names=["row", "instrument_id", "price"])

    store, at = pafs.FileSystem.from_uri(path)
    size = store.get_file_info(at).size
    if size % (4 * width):
        raise BadInput(f"{path}: not whole rows of {width} prices")
    return spark.range(size // (4 * width)).mapInArrow(decode, "row long, instrument_id long, price float")


def run_line(command: str, params: dict, seconds: float, time: str | None = None, **told: object) -> str:
    """A JSON line of time (now, UTC), command, settings as text, seconds, peak memory and what the run tells."""
    line = {
        "time": time or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "command": command, "params": {k: str(v) for k, v in params.items() if k != "runlog"},
        "wall_seconds": seconds, "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
    }
    return json.dumps(line | told)


class RunLog:
    """Appends a line for a run that ends well, to a file of the driver's machine."""

    def __init__(self, path: str | None, command: str, params: dict):
        self.path, self.command, self.params, self.told = path, command, params, {}

    def __enter__(self) -> RunLog:
        self.began = time.time()
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(run_line(self.command, self.params, time.time() - self.began, **self.told) + "\n")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs, newest first; blank and malformed lines are dropped."""
    schema = "time string, command string, params map<string,string>, wall_seconds double, peak_rss_bytes long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("time is not null").orderBy(F.desc("time"))


def shown_params(params: Column, hidden: tuple[str, ...] = ("store", "in", "out", "summary", "reverters")) -> Column:
    """A run's settings without those that only name files."""
    return F.map_filter(params, lambda k, _: ~k.isin(*hidden))
