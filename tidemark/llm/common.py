"""What the operators of this subpackage share: table paths, staged tables, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, new_path, run_dir, shared_dir, staged

__all__ = ["WORD", "discard", "input_columns", "new_path", "row_key", "run_dir", "shared_dir", "staged", "table"]

#: Characters that separate words: space and the controls tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_name(doc_id: Column, text: Column) -> Column:
    """Hex of 128 bits of id and text: what tells rows apart, also where ids are null or repeat."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), text).cast("binary"))


def row_key(doc_id: Column, text: Column) -> Column:
    """The same as 16 bytes."""
    return F.unhex(row_name(doc_id, text))


def input_columns(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
