"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's applications, with their file systems; removed when it ends.
_mine: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own; a cluster gets an error,
    as no folder of one machine will do there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints/tidemark-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It goes when the process ends: results are to be written elsewhere."""
    at = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if at not in _mine:
        _mine[at] = _path(spark, at)
    return at


@atexit.register
def _clear() -> None:
    for fs, path in _mine.values():
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder is left then
            fs.delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, on whatever store they lie."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            fs, path = _path(df.sparkSession, file)
            fs.delete(path.getParent(), True)
