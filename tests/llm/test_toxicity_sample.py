from pyspark.sql import functions as F

from vellum.llm import toxicity


def test_training_rows_come_in_hash_order(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = [t for t, _ in toxicity.training_rows(docs, labels)]
    want = docs.where(~toxicity.held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    assert got == [r["text"] for r in want] != [r["text"] for r in sorted(want)]
