"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, nearcopies, quality, sharding
from tidemark.llm.common import new_path, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on what is labelled of docs, doesn't reject.

    A null text is judged as empty; repeated rows are judged alike and all stay or go; without labelled rows every score is
    one half, and all stay."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that near copies link: five-word shingles, Jaccard similarity 0.8 or more.

    The least doc_id stays, a null one only where there is no other; of rows that agree in id and text one; null and empty
    texts and those without words are copies of each other; a text of fewer than five words is one shingle."""
    return nearcopies.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; items without words are held by none; repeated
    rows all stay or go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, rows repeated or cut as the mix takes them. Texts without words take no part; a
    null source is one of its own; repeated rows are rows of their own."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard. Rows that agree in id and text, as the mix makes them, lie in one bucket, which is cut by
    number where it is too large; a null text has 0 bytes. Columns named as the added ones are replaced."""
    return sharding.sharded(docs)


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", uncontaminated), ("mixture", mixture), ("shards", shards)]
#: SQL has no word for the classifier, the fingerprints' hash or the alignment; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
