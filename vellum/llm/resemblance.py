"""Near-duplicates by the Jaccard similarity of word shingles, as whole texts show it.

Candidates come from the SimHash tries of ``simhash``, as texts within its three bits, and, for those farther
apart, from MinHash: ``BANDS`` bands of ``ROWS`` least hashes, so a pair at the similarity sought, 0.8,
shares one with a probability of 0.99997 (1 - (1 - 0.8^4)^20), one above it likelier.
Each link is checked on the whole sets of shingles.  Equal sets enter once.

Wanted are the groups that links make, so a pair in one group already needs no check.  The members of
a group of fingerprints and those of a band are first held against one of them, then, where several
groups are left in a band, those of other groups against another.  What is still in bands of several groups is joined by prefixes, which is exact:
with shingles in order of how many of these sets have them, sets of similarity 0.8 share one of the
first n - ceil(0.8 n) + 1.  Sets that only share a common passage have shingles of their own in front
and never meet, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, free_name, text_or_empty, tidy
from vellum.llm.components import components
from vellum.llm.simhash import fingerprint, grouped_prints

SHINGLE = 5
#: Least similarity of near-duplicates, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
SEED = 42
_RANDOM = np.random.default_rng(SEED)
_TURN, _TIMES = (_RANDOM.integers(1, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) for _ in range(2))
_TIMES = _TIMES << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as ascending hashes; words are those of ``simhash.fingerprint``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def bands(own: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 1 << 12):
        least = np.minimum(least, ((own[at : at + (1 << 12)] ^ _TURN) * _TIMES).min(axis=1))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, prints, keys, ends = [], [], [], [0]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                prints.append(fingerprint(text))
                own = shingles(text, size)
                signs.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                keys += bands(own) if len(own) else []
                ends.append(len(keys))
            listed = pa.ListArray.from_arrays(np.array(ends, np.int32), pa.array(_signed(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_signed(signs)), pa.array(_signed(prints)), listed], names=["id", "mark", "sign", "fp", "bands"])
        tidy()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, size).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["sign", "own"])
        tidy()

    return run


def _near(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0])
    return pd.Series(out, dtype=bool)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *own]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], names=["sign", "root", "tokens"])


def _prefix_pairs(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(u, v, ru, rv)``: pairs of ``wanted(sign, root)``, of different roots, that share a shingle of their prefixes."""
    listed = wanted.join(sets, "sign").select("sign", "root", "own").mapInArrow(_tokens, "sign long, root long, tokens array<long>")
    tokens = cut(listed.select("sign", "root", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    often = tokens.groupBy("token").agg(F.count("*").alias("times"))
    rare = F.struct("times", "token")
    ordered = tokens.join(often, "token").groupBy("sign", "root", "n").agg(F.sort_array(F.collect_list(rare)).alias("all"))
    # n - ceil(n * 4 / 5) + 1
    head = F.col("n") - F.expr(f"(n * {LEAST[0]} + {LEAST[1] - 1}) DIV {LEAST[1]}").cast("int") + 1
    # a shingle that no other set has joins nothing
    prefix = ordered.select("sign", "root", "n", F.explode(F.filter(F.slice("all", F.lit(1), head), lambda t: t["times"] > 1)).alias("t"))
    prefix = cut(prefix.select("sign", "root", "n", F.col("t.token").alias("token")))
    # the largest group of a shingle's sets is only held against the others
    largest = prefix.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    several = cut(prefix.join(largest, "token"))
    other = several.select(F.col("sign").alias("v"), F.col("root").alias("rv"), F.col("n").alias("m"), "token")
    met = several.where("root <> major").join(other, "token").where((F.col("root") != F.col("rv")) & ((F.col("rv") == F.col("major")) | (F.col("sign") < F.col("v"))))
    met = met.where((F.col("n") * LEAST[1] >= F.col("m") * LEAST[0]) & (F.col("m") * LEAST[1] >= F.col("n") * LEAST[0]))
    return met.select(F.col("sign").alias("u"), "v", F.col("root").alias("ru"), "rv")


def _print_pairs(own: DataFrame) -> DataFrame:
    """``(u, v)``: the least set of each group of fingerprints, by the tries of ``simhash``, with every other one."""
    prints = own.select("sign", "fp").distinct()
    placed = cut(prints.join(grouped_prints(cut(prints.select("fp").distinct())), "fp").select("sign", "root").distinct())
    least = placed.groupBy("root").agg(F.min("sign").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return cut(placed.join(least, "root").where("sign <> u").select("u", F.col("sign").alias("v")).distinct())


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, mark, root)``: rows that links of similarity 0.8 or more join have one root; ``mark`` hashes the text."""
    text = text_or_empty(text_column)
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    own = cut(named.mapInArrow(_signatures(size), "id long, mark long, sign long, fp long, bands array<long>"))
    once = own.where("size(bands) > 0").groupBy("sign").agg(F.min(F.struct("mark", "id", "bands")).alias("one"))
    once = cut(once.select("sign", "one.id", "one.mark", "one.bands"))
    keyed = once.select("sign", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("sign").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, "band"))
    tried = _print_pairs(own.where("size(bands) > 0"))
    known = cut(members.select("sign").union(tried.select("u")).union(tried.select("v")).distinct())
    wanted = once.join(known, "sign").select("sign", F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    texts = named.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("sign", "t")
    sets = cut(texts.mapInArrow(_sets(size), "sign long, own binary").dropDuplicates(["sign"]))
    near = F.pandas_udf(_near, "boolean")

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs ``(u, v, ru, rv)``, sets and their groups, the groups that are linked."""
        left, right = sets.select(F.col("sign").alias("u"), F.col("own").alias("x")), sets.select(F.col("sign").alias("v"), F.col("own").alias("y"))
        return cut(pairs.dropDuplicates(["u", "v"]).join(left, "u").join(right, "v").where(near("x", "y")).select(F.col("ru").alias("u"), F.col("rv").alias("v")))

    def merged(groups: DataFrame, linked: DataFrame) -> DataFrame:
        roots = components(linked)
        return cut(groups.join(roots, groups["root"] == roots["node"], "left").select("sign", F.coalesce(roots["root"], groups["root"]).alias("root")))

    def unsettled(groups: DataFrame) -> DataFrame:
        """Members of bands that hold sets of several groups, but for bands of two, which have been compared."""
        placed = members.where("n > 2").select("band", "sign").join(groups, "sign")
        several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
        return cut(placed.join(several, "band"))

    groups = known.select("sign", F.col("sign").alias("root"))
    starred = members.where("sign <> lead").select(F.col("lead").alias("u"), F.col("sign").alias("v"))
    groups = merged(groups, links(starred.union(tried).select("u", "v", F.col("u").alias("ru"), F.col("v").alias("rv"))))
    rest = unsettled(groups)
    if not rest.isEmpty():
        lead = rest.groupBy("band").agg(F.min_by(F.struct(F.col("sign").alias("u"), F.col("root").alias("ru")), F.xxhash64("sign", "band")).alias("l"))
        again = rest.join(lead, "band").where("root <> l.ru").select("l.u", F.col("sign").alias("v"), "l.ru", F.col("root").alias("rv"))
        groups = merged(groups, links(again))
        rest = unsettled(groups)
    if not rest.isEmpty():
        groups = merged(groups, links(_prefix_pairs(sets, rest.select("sign", "root").distinct())))
    roots = groups.withColumnRenamed("sign", "node")
    found = own.select("id", "mark", "sign").join(roots.withColumnRenamed("node", "sign"), "sign", "left")
    return found.select("id", "mark", F.coalesce("root", "sign").alias("root"))


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id, then of the least mark.

    A null id comes after all others.  Texts without words are one group.
    """
    groups = near_groups(docs, id_column, text_column, size)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    kept = groups.groupBy("root").agg(F.min(key).alias("least")).select("least.id", "least.mark")
    id_, mark = free_name(docs, "kept_id"), free_name(docs, "kept_mark")
    kept = kept.select(F.col("id").alias(id_), F.col("mark").alias(mark))
    keys = F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(text_column)) == F.col(mark))
    return docs.join(kept, keys).dropDuplicates([id_, mark]).select(*docs.columns)
