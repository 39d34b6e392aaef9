"""Training rows for the classifiers: a bounded, documented sample of labelled documents outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import input_columns, staged

#: Labelled rows that a model is fitted on at most: those of the smallest hashes.
TRAIN_ROWS = 20_000


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is 0 mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label of at most rows labelled documents outside the held-out fold and no null label: one for each id,
    of documents that share an id the one whose text has the least hash.

    The chosen ids, and then the chosen hashes, are at most rows numbers, so they are broadcast; each text is read where
    it lies. Rows that agree in id and text are left to be told apart by once()."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = staged(chosen, "training-ids")
    hashed = input_columns(docs).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    least = staged(hashed.groupBy("doc_id").agg(F.min("h").alias("h")), "training-hashes")
    return hashed.join(F.broadcast(least), ["doc_id", "h"]).select("doc_id", "text", "label")


def once(rows: DataFrame) -> DataFrame:
    """One row for each doc_id of what has been made of training rows; those of an id are alike."""
    return rows.dropDuplicates(["doc_id"])
