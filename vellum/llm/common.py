"""What the operators share: table reading, the shared folder, lineage cuts and row identity."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset and all runs in one process (tests) is a folder made here; a cluster has to
    name one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="vellum-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return context.getConf().get("spark.checkpoint.dir") or named


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without the lineage behind them."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark's file systems have it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores if the frame has such a column (case is ignored)."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
