"""Queries on paragraphs and words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.registry import Registry, table

REGISTRY = Registry()

#: Splits a line at white space in Unicode's sense.
WORD_GAP = r"(?U)\s+"


@REGISTRY.query(
    """
    SELECT doc_id,
           CAST(count(*) AS BIGINT) AS paragraphs,
           CAST(sum(words) AS BIGINT) AS words,
           CAST(sum(CASE WHEN words < 10 THEN words ELSE 0 END) AS BIGINT) AS words_short,
           CAST(sum(CASE WHEN words >= 10 AND words < 100 THEN words ELSE 0 END) AS BIGINT) AS words_middle,
           CAST(sum(CASE WHEN words >= 100 THEN words ELSE 0 END) AS BIGINT) AS words_long
    FROM (SELECT doc_id, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) AS words
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    GROUP BY doc_id
    """
)
def word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (lines) and words of each document, bucketed by the paragraph's length."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    words = F.size(F.filter(F.split("line", WORD_GAP), lambda w: w != ""))
    counted = lines.select("doc_id", words.cast("long").alias("words"))
    part = lambda where: F.sum(F.when(where, F.col("words")).otherwise(0))
    return counted.groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"),
        F.sum("words").alias("words"),
        part(F.col("words") < 10).alias("words_short"),
        part((F.col("words") >= 10) & (F.col("words") < 100)).alias("words_middle"),
        part(F.col("words") >= 100).alias("words_long"),
    )
