"""Recorded step timings: JSON lines in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "kind string, name string, at string, outcome string, steps array<struct<name:string,seconds:double,status:string>>, sweeps boolean, _torn string"


def record(runs: DataFrame, folder: str) -> None:
    runs.write.mode("append").json(folder)


def read(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """All runs; a torn line is left out."""
    found = spark.read.schema(RUN).option("columnNameOfCorruptRecord", "_torn").json(folder).where("_torn IS NULL AND steps IS NOT NULL").drop("_torn")
    return found if kind is None else found.where(F.col("kind") == kind)


def steps(runs: DataFrame) -> DataFrame:
    """Steps that went well, of runs not made under load."""
    flat = runs.where("sweeps IS NULL OR NOT sweeps").select("kind", "at", F.posexplode("steps").alias("pos", "s"))
    return flat.select("kind", "at", "pos", "s.*").where("status = 'ok'")
