"""The training-data pipeline: what a raw corpus goes through before it is trained on.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import linededup, mixing, packing, resemblance, toxicity
from vellum.llm.common import drop_folder, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    All others stay as they are, with all columns: repeated rows, null ids and null or empty texts (which
    score as clean) too.  An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages go; every document stays, be its text empty then.

    The order is that of ids, null ones first, then of a hash of the text; a repeated row (same id and
    text) is the same document again and loses the same.  Null texts stay null.
    """
    return linededup.dedup_passages(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least id, null last.

    Candidates come from op9's tries of fingerprints, and from MinHash for those farther apart than its three
    bits; each link is checked on the whole sets of shingles.
    Texts without words, null ones among them, are one group.  Repeated rows are copies of each other.
    """
    return resemblance.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, at most twice, with all its columns.

    Rows alike in all columns are told apart by nothing, so their copies add up.  A null source is a source;
    one without words gives nothing.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their token ids.

    A null or empty text is the end token alone.  Repeated rows are packed each on its own.
    """
    pieces = packing.pack(docs, packing.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Cube sampling, fingerprints and tokenising are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two of them is written to the shared folder.

    What a stage left goes once the next has been written; the last stage reads what the one before left.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
