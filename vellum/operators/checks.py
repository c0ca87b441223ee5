"""Set-oriented checks: what one table has and another lacks, what repeats, what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of passages that a containment join sends to every task; more are taken in parts.
PASSAGE_BYTES = 8 << 20


def missing(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't listed."""
    return rows.join(listed.select(*keys), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def changes(before: DataFrame, after: DataFrame, key: str, print_: str) -> DataFrame:
    """``(key, change)`` of what was added, removed or has another fingerprint."""
    b = before.select(F.col(key).alias("_b"), F.col(print_).alias("_was"))
    a = after.select(F.col(key).alias("_a"), F.col(print_).alias("_now"))
    joined = b.join(a, F.col("_b") == F.col("_a"), "full_outer").where(~F.col("_was").eqNullSafe(F.col("_now")))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return joined.select(F.coalesce("_b", "_a").alias(key), change.alias("change"))


def multiset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained with ``side`` and ``times``; one aggregate over both sides, no join."""
    columns = before.columns
    both = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1)))
    summed = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return summed.select(*columns, F.when(F.col("_n") > 0, "lost").otherwise("gained").alias("side"), F.abs("_n").alias("times"))


def report(findings: dict[str, DataFrame]) -> DataFrame:
    """All findings in one table, named."""
    return reduce(DataFrame.unionByName, (f.select(F.lit(name).alias("finding"), *f.columns) for name, f in findings.items()))


def verdict(rows: DataFrame, truth: str, proposal: str, now: str) -> DataFrame:
    """``verdict``: the text now is the proposal (kept), the earlier truth (reverted) or neither (authored)."""
    said = F.when(F.col(now).eqNullSafe(F.col(proposal)), "kept").when(F.col(now).eqNullSafe(F.col(truth)), "reverted")
    return rows.withColumn("verdict", said.otherwise("authored"))


def containment(docs: DataFrame, id_: str, text: str, passages: DataFrame, item: str, passage: str, limit: int = PASSAGE_BYTES) -> DataFrame:
    """``(id, item)`` of each document that holds a passage whole.

    A passage's longest word between spaces that are its own is a word of every document that holds it,
    so words and passages meet in an equi-join, and only what meets is searched.  Passages without such a
    word (fewer than three) are searched for in all documents; they are sent out in parts of at most
    ``limit`` bytes.
    """
    words = F.split(F.col(passage), " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    sign = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    named = passages.select(F.col(item).alias("_item"), F.col(passage).alias("_passage"), sign.alias("_sign"))
    # a word between two spaces of a passage is one between two spaces of the text that holds it
    bare = docs.select(id_, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("_sign"))
    signs = named.where("_sign <> ''").select("_sign").distinct()
    met = bare.join(signs, "_sign").join(named, "_sign").select(F.col(id_).alias("_id"), "_item", "_passage")
    found = [docs.select(id_, text).join(met, F.col(id_).eqNullSafe(F.col("_id"))).where(F.expr(f"contains({text}, _passage)")).select(id_, F.col("_item").alias(item))]
    short = named.where("_sign IS NULL OR _sign = ''")
    size = short.agg(F.sum(F.octet_length("_passage") + 1)).first()[0] or 0
    parts = -(-size // limit)
    for k in range(parts):
        part = short.where(F.pmod(F.xxhash64("_item", "_passage"), F.lit(parts)) == k)
        found.append(docs.select(id_, text).join(F.broadcast(part), F.expr(f"contains({text}, _passage)")).select(id_, F.col("_item").alias(item)))
    return reduce(DataFrame.unionByName, found)
