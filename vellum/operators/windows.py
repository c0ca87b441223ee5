"""Ordered checks: sequences, runs, medians and ranks within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(at)).where("_k = 1").drop("_k")


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= k).drop("_k")


def overlaps(spans: DataFrame, doc: str, name: str, start: str, stop: str) -> DataFrame:
    """``(doc, a, b)`` of spans of a document that overlap, a before b by name.

    An equi-join on the document with the range as its condition: documents bound what is compared.
    """
    a = spans.select(doc, F.col(name).alias("a"), F.col(start).alias("_s"), F.col(stop).alias("_e"))
    b = spans.select(doc, F.col(name).alias("b"), F.col(start).alias("_t"), F.col(stop).alias("_f"))
    return a.join(b, doc).where("a < b AND _s < _f AND _t < _e").select(doc, "a", "b")


def off_mode(rows: DataFrame, doc: str, value: str) -> DataFrame:
    """``(doc, value, times, mode)`` of values other than their document's most common; the least wins a tie."""
    counted = rows.groupBy(doc, value).agg(F.count("*").alias("times"))
    order = Window.partitionBy(doc).orderBy(F.desc("times"), value)
    return counted.withColumn("mode", F.first(value).over(order)).where(F.col(value) != F.col("mode"))


def regressions(log: DataFrame, name: str, seconds: str, order: list[str], slower: float = 1.25, floor: float = 2.0) -> DataFrame:
    """Steps with six runs or more whose median over the recent third (three at least) is slower.

    ``slower`` times the earlier median and ``floor`` seconds more are both needed.  Medians are exact.
    """
    newest = Window.partitionBy(name).orderBy(*(F.desc(c) for c in order))
    placed = log.select(name, F.col(seconds).alias("_s"), F.row_number().over(newest).alias("_k"), F.count("*").over(Window.partitionBy(name)).alias("samples"))
    recent = F.col("_k") <= F.greatest(F.lit(3), F.expr("samples DIV 3"))
    half = lambda where: F.percentile(F.when(where, F.col("_s")), F.lit(0.5))
    medians = placed.where("samples >= 6").groupBy(name, "samples").agg(half(~recent).alias("was"), half(recent).alias("now"))
    return medians.where((F.col("now") >= F.col("was") * slower) & (F.col("now") - F.col("was") >= floor)).select(name, "was", "now", (F.col("now") - F.col("was")).alias("delta"), "samples")


def underfilled(sheets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``sheets(doc, sheet, chars, exhibit)`` that hold less than ``threshold`` of their document's fullest sheet of text.

    A sheet that an exhibit is on is none of text; a document's first and last are short for reasons of their own.
    """
    whole = Window.partitionBy("doc")
    full = F.max(F.when(~F.col("exhibit"), F.col("chars"))).over(whole)
    edge = (F.col("sheet") == F.min("sheet").over(whole)) | (F.col("sheet") == F.max("sheet").over(whole))
    told = sheets.withColumn("fullest", full).withColumn("_edge", edge)
    return told.where(~F.col("exhibit") & ~F.col("_edge") & (F.col("chars") < F.col("fullest") * threshold)).drop("_edge")


def blamed(short: DataFrame, landings: DataFrame) -> DataFrame:
    """``short(doc, sheet)`` with ``exhibit``, that of ``landings(doc, exhibit, first)`` which starts on the next sheet, null if none."""
    l = landings.groupBy(F.col("doc").alias("_d"), F.col("first").alias("_f")).agg(F.min("exhibit").alias("exhibit"))  # noqa: E741
    return short.join(l, (F.col("doc") == F.col("_d")) & (F.col("sheet") + 1 == F.col("_f")), "left").drop("_d", "_f")


def off_majority(rows: DataFrame, doc: str, value: str, least: int = 8, share: float = 0.9, odd: int = 2) -> DataFrame:
    """Rows whose value isn't their document's practice: one that ``least`` rows and ``share`` of them have, with ``odd`` others at most."""
    counted = rows.groupBy(doc, value).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(doc)))
    order = Window.partitionBy(doc).orderBy(F.desc("_n"), value)
    house = counted.withColumn("_k", F.row_number().over(order)).where((F.col("_k") == 1) & (F.col("_n") >= least) & (F.col("_n") >= F.col("_all") * share) & (F.col("_all") - F.col("_n") <= odd))
    named = house.select(F.col(doc).alias("_d"), F.col(value).alias("practice"))
    return rows.join(named, F.col(doc) == F.col("_d")).where(F.col(value) != F.col("practice")).drop("_d")


def numbering_breaks(sheets: DataFrame, doc: str, sheet: str, printed: str) -> DataFrame:
    """Sheets whose printed number isn't one more than the one before: RESTART or JUMP."""
    was = F.lag(printed).over(Window.partitionBy(doc).orderBy(sheet))
    broken = sheets.withColumn("_was", was).where(F.col(printed) != F.col("_was") + 1)
    return broken.select(doc, sheet, printed, F.when(F.col(printed) <= F.col("_was"), "RESTART").otherwise("JUMP").alias("finding"))


def not_in_sequence(rows: DataFrame, parent: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number isn't their place under the parent."""
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(*order)).cast("long")
    return rows.withColumn("expected", place).where(F.col(number) != F.col("expected"))


def forward_fill(rows: DataFrame, doc: str, pos: str, value: str) -> DataFrame:
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def islands(rows: DataFrame, doc: str, pos: str, value: str) -> DataFrame:
    """``(doc, island, value, start, stop, length)`` of runs of neighbours with one value."""
    order = Window.partitionBy(doc).orderBy(pos)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1)).cast("long")
    numbered = rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "island", value).agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("length"))


def renumber(rows: DataFrame, doc: str, item: str, at: str) -> DataFrame:
    """``(doc, item, number)``: items numbered from 1 by where they are first seen, then by name."""
    first = rows.groupBy(doc, item).agg(F.min(at).alias("_at"))
    return first.select(doc, item, F.dense_rank().over(Window.partitionBy(doc).orderBy("_at", item)).cast("long").alias("number"))
