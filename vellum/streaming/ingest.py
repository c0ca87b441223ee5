"""Packages as they arrive: the same readers over a stream of files.

Parts and their rows are made one file at a time, so no state is kept; findings of a run of files go
to a folder of their batch, so a batch that is done again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import documents
from vellum.sources.packages import PARTS, _unzip


def stream_parts(spark: SparkSession, path: str, pattern: str = "*.docx", files_per_batch: int = 1000) -> DataFrame:
    """``(doc, part, ord, blob, error)`` of packages as they are put under a path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select("path", "content").mapInArrow(_unzip(None), PARTS)


def audit(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.docx") -> StreamingQuery:
    """Structural faults and unreadable files of all that is there now, as Parquet in ``out/batch=N``, each file once."""

    def write(batch: DataFrame, number: int) -> None:
        broken = batch.where("error IS NOT NULL").select("doc", F.lit("no-package").alias("code"), F.col("error").alias("where"))
        documents.lint(batch).unionByName(broken).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream_parts(spark, path, pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
