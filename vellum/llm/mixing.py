"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target in words; a document of it is taken ``target / source size`` times in
expectation.  The whole part of that is taken as it is, the fraction is an inclusion probability.
The flight phase moves three fractional probabilities at a time along the null-space of two
balancing constraints, so that the source's expected words and number of documents stay as they
are, until one of them is 0 or 1.  It streams: a task holds three undecided documents however large
a source is.  Each run of ``RUN`` documents leaves two at most; those of ``FAN`` runs meet in the
next level, until a source has two left, which are landed on the nearest total.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from vellum.llm.common import cut, free_name, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
RUN = 4096
FAN = 512
SEED = 20260
#: Decisions of a last run that its landing may still turn round; earlier ones are passed on.
HELD = 8192
#: Where a unit has its size: (source_at, run, key, size, base).
SIZE = 3
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_rows, source_size, weight, target)`` of documents ``(source, size)``.

    Sources in code point order, null last, weigh ``weights`` in turn.  The targets share ``share``
    times all words by weight; one that would pass ``most`` times its source's size stops there and
    the rest is shared again, which is the level at which least(most * size, level * weight) add up.
    The windows are over one row per source, which documents are summed to before any shuffle.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    bound = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    stepped = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= bound / F.col("weight"))
    # past the first that fits, capping sources that need no cap only lowers the level
    chosen = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    target = F.when(chosen.isNull(), bound).otherwise(F.least(bound, chosen * F.col("weight")))
    return stepped.withColumn("target", target).select("source", "source_rows", "source_size", "weight", "target")


class Flight:
    """The flight of one run of units; ``decided`` collects [unit, 0 or 1, may still be flipped]."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed).random
        self.p: list[float] = []
        self.s: list[float] = []
        self.unit: list = []
        self.decided: list[list] = []
        self.drift = 0.0  # words decided on, less those expected of all units that came

    def _decide(self, unit: tuple, taken: int, free: bool) -> None:
        self.decided.append([unit, taken, free])
        self.drift += taken * unit[SIZE]

    def add(self, unit: tuple, p: float) -> None:
        self.drift -= p * unit[SIZE]
        if p <= EPS or p >= 1 - EPS:
            self._decide(unit, int(p > 0.5), False)
            return
        self.p.append(p)
        self.s.append(unit[SIZE])
        self.unit.append(unit)
        if len(self.p) == 3:
            self._step()

    def _step(self) -> None:
        p, (a, b, c) = self.p, self.s
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x) / v if v > 0 else -x / v for x, v in zip(p, u, strict=True) if v)
        down = min(x / v if v > 0 else (x - 1) / v for x, v in zip(p, u, strict=True) if v)
        step = up if self.draw() * (up + down) < down else -down
        for i in (2, 1, 0):
            p[i] += step * u[i]
            if p[i] <= EPS or p[i] >= 1 - EPS:
                self._decide(self.unit[i], int(p[i] > 0.5), True)
                del p[i], self.s[i], self.unit[i]

    def land(self) -> None:
        """Decide what is left on the nearest total of words, then of documents.

        Where that is off by more than some held decision's words, the decision that helps most is
        turned round, again while it helps.
        """
        n, number = len(self.p), sum(self.p)
        ways = []
        for way in range(1 << n):
            take = [way >> i & 1 for i in range(n)]
            off = self.drift + sum(t * s for t, s in zip(take, self.s, strict=True))
            ways.append((abs(off), abs(sum(take) - number), take))
        for unit, t in zip(self.unit, min(ways)[2], strict=True):
            self._decide(unit, t, True)
        self.p, self.s, self.unit = [], [], []
        free = [d for d in self.decided if d[2] and d[0][SIZE]]
        while free:
            best = min(free, key=lambda d: abs(self.drift + (-d[0][SIZE] if d[1] else d[0][SIZE])))
            turned = self.drift + (-best[0][SIZE] if best[1] else best[0][SIZE])
            if abs(turned) >= abs(self.drift):
                break
            self.drift, best[1] = turned, 1 - best[1]


def _fly(last: bool, level: int):
    """Rows sorted by (source_at, run) -> the same rows with ``p`` 0 or 1 where decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, group, schema = None, None, None
        out: list[tuple] = []

        def release(keep: int) -> None:
            n = len(flight.decided) - keep
            if n > 0:
                out.extend((*unit, float(t)) for unit, t, _ in flight.decided[:n])
                del flight.decided[:n]

        def close() -> None:
            if flight is None:
                return
            if last:
                flight.land()
            release(0)
            out.extend((*unit, p) for unit, p in zip(flight.unit, flight.p, strict=True))

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], names=schema.names)
            out.clear()
            return made

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != group:
                    close()
                    group = row[:2]
                    flight = Flight(SEED + 1_000_003 * level + 7_919 * group[0] + group[1])
                flight.add(row[:-1], row[-1])
            if flight is not None:
                release(HELD if last else 0)
            if out:
                yield emit()
        close()
        if out:
            yield emit()

    return run


def mix(sizes: DataFrame) -> DataFrame:
    """``sizes(key, source, size)`` with ``source_size, target, copies``: how often each row is taken.

    Rows with equal keys are taken each on its own.  A null source is a source; sizes of zero are
    taken like others and add no words.  A source of no words has target zero and takes nothing.
    Empty tables give no rows.  The same rows give the same copies in any partitioning.
    """
    goal = cut(targets(sizes).withColumn("source_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"]), "left").select(
        F.col("source_at").cast("long").alias("source_at"),
        F.pmod(F.xxhash64("key", "size"), F.ceil(F.col("source_rows") / RUN)).cast("long").alias("run"),
        "key", F.col("size").cast("long").alias("size"), F.floor(share + EPS).cast("long").alias("base"),
        F.greatest(share - F.floor(share + EPS), F.lit(0.0)).alias("p"),
    )
    most = goal.agg(F.max(F.ceil(F.col("source_rows") / RUN))).first()[0] or 1
    done: list[DataFrame] = []
    left, level = units, 0
    while True:
        last = most <= 1
        order = ["source_at", "run", F.desc("size"), "key"]
        flown = left.repartition("source_at", "run").sortWithinPartitions(*order).mapInArrow(_fly(last, level), left.schema)
        if last:
            done.append(flown)
            break
        flown = cut(flown)
        done.append(flown.where("p IN (0, 1)"))
        left = flown.where("p NOT IN (0, 1)").withColumn("run", F.floor(F.col("run") / FAN).cast("long"))
        most, level = -(-int(most) // FAN), level + 1
    decided = done[0]
    for part in done[1:]:
        decided = decided.unionByName(part)
    named = goal.select("source_at", "source", "source_size", "target")
    return decided.join(named, "source_at").select("key", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def sizes_of(docs: DataFrame, key: str, source_column: str = "source", text_column: str = "text") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source_column).cast("string").alias("source"), size.alias("size"))


def mixed_documents(docs: DataFrame, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    Rows that are alike in all columns are interchangeable, so their copies are added up.  A row's key
    is 128 bits of hash: of its values, in two orders, and of which of them are null (the hash passes
    over those).  Maps are told apart by their entries in order.
    """
    key, copies = free_name(docs, "row_key"), free_name(docs, "row_copies")
    plain = [F.array_sort(F.map_entries(c)) if isinstance(docs.schema[c].dataType, MapType) else F.col(c) for c in docs.columns]
    nulls = [F.col(c).isNull() for c in docs.columns]
    keyed = docs.withColumn(key, F.concat_ws(" ", F.xxhash64(*plain, *nulls), F.xxhash64(F.lit(SEED), *nulls, *reversed(plain))))
    taken = mix(sizes_of(keyed, key, source_column, text_column)).groupBy("key").agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    once = keyed.dropDuplicates([key])
    joined = once.join(taken.withColumnRenamed("key", key), key)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mix(sizes_of(table(spark, sf_dir, "documents"), "doc_id"))
    return mixed.select(
        F.col("key").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "source",
    )
