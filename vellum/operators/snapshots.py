"""Anchors of a protocol resolved on a manuscript frozen as numbered text.

An anchor names a text that is to be there once; where it is, in a paragraph, cell or note, and how
often, decides its verdict.  Anchors are few and their size is checked before they are sent out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import normalize_glyphs

#: Bytes of anchors that go to every task at once; a longer list is joined by document.
ANCHOR_BYTES = 8 << 20


def numbered(blocks: DataFrame) -> DataFrame:
    """``(doc, place, text)``: P1, P2, ... for the paragraphs of the body that hold something, T1:1, ... in tables."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc", F.col("table").isNull()).orderBy("pos")
    inside = Window.partitionBy("doc", "table").orderBy("pos")
    shown = blocks.where("kind <> 'table'")
    place = F.when(F.col("table").isNull(), F.concat(F.lit("P"), F.row_number().over(order))).otherwise(F.concat(F.lit("T"), F.col("table") + 1, F.lit(":"), F.row_number().over(inside)))
    return shown.select("doc", place.alias("place"), "text")


def resolve(places: DataFrame, anchors: DataFrame, normalize: bool = False) -> DataFrame:
    """``(doc, anchor, verdict, hits, place)`` of anchors ``(doc, anchor, text)``: found, missing or ambiguous."""
    fold = normalize_glyphs if normalize else (lambda c: c)
    size = anchors.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = anchors.select(F.col("doc").alias("_doc"), "anchor", F.col("text").alias("_text"))
    wanted = F.broadcast(wanted) if size <= ANCHOR_BYTES else wanted
    found = places.join(wanted, F.col("doc") == F.col("_doc")).where(F.contains(fold(F.col("text")), fold(F.col("_text"))))
    # how often the text is in a place: what its removal takes away
    times = ((F.length(fold(F.col("text"))) - F.length(F.replace(fold(F.col("text")), fold(F.col("_text")), F.lit("")))) / F.length("_text")).cast("long")
    counted = found.groupBy(F.col("doc").alias("_d"), F.col("anchor").alias("_a")).agg(F.sum(times).alias("hits"), F.min("place").alias("place"))
    joined = anchors.join(counted, (F.col("doc") == F.col("_d")) & (F.col("anchor") == F.col("_a")), "left")
    hits = F.coalesce("hits", F.lit(0))
    verdict = F.when(hits == 0, "missing").when(hits == 1, "found").otherwise("ambiguous")
    return joined.select("doc", "anchor", verdict.alias("verdict"), hits.alias("hits"), "place")


KINDS = ("replace", "append", "insert_after", "present")


def parse_spec(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(anchor, kind, scope, text)`` of a spec, an anchor a line: scope and text parted by a tab, a kind before the scope with ``@``; comments and blank lines are none."""
    wanted = lines.where(f"trim({line}) <> '' AND NOT startswith(trim({line}), '#')")
    place, text = F.split(line, "\t", 2)[0], F.try_element_at(F.split(line, "\t", 2), F.lit(2))
    kind = F.when(F.contains(place, F.lit("@")), F.substring_index(place, "@", 1)).otherwise("replace")
    return wanted.select(F.concat_ws("=", place, text).alias("anchor"), kind.alias("kind"), F.substring_index(place, "@", -1).alias("scope"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("kind").isin(*KINDS))


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    return parse_spec(spark.read.text(path))


def parse_anchor(said: str) -> tuple[str, str, str]:
    """(kind, scope, text) of an anchor as a command line has it: ``[kind@]scope=text``."""
    place, _, text = said.partition("=")
    kind, at, scope = place.rpartition("@")
    return (kind if at else "replace"), scope, text
